"""Part of vigilrow; see the modules inside."""

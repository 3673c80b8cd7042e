"""vigilrow: static risk analytics over text artifacts, expressed as Spark DataFrame jobs."""

"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written: what is built on it neither repeats its work nor grows its plan.

    The folder is the session's spark.checkpoint.dir; where none is set, as in tests, one in the warehouse. It must be shared: on a
    cluster a local one is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        if at.startswith(("file:", "/")) and not context.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(at)
    return df.checkpoint()

"""Cut points of iterative jobs: tables written to the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written and read back, so that lost executors cost no earlier steps. A folder of our own is set only where the
    session names none and runs on one machine."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-cuts-"))
    return df.checkpoint(eager=True)

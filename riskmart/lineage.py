"""Fixing a frame's rows outside the executors."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder the session names in `spark.checkpoint.dir`.

    A local session without one gets a temporary folder; a cluster session must name it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskmart-")
        sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared folder as Parquet and reads it back.

    Later passes scan the stored columns they need instead of repeating the plan, and
    see the same rows whatever executors are lost in between.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/riskmart-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables that a query writes because it reads them many times: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where all of Spark runs on it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            place = known.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            place = f"{tempfile.gettempdir()}/marketloom-scratch"
        else:
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return place.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends here, and losing an executor loses nothing."""
    path = f"{folder(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

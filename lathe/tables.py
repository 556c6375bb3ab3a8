"""Reading the test tables, and the session the library is written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "lathe", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.ui.enabled", "false").getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant: watermarks refuse timestamps without a zone."""
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))

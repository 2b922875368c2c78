"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.jsoncheck import DUPLICATE_KEYS_CONF


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for a session made elsewhere.

    A JSON object that repeats a key keeps the last value. The checks of JSON texts refuse a session without it.
    """
    spark.conf.set(DUPLICATE_KEYS_CONF, "true")
    return spark


def local_session(name: str, cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)

"""SparkSession factory used by the benchmark and by the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with adaptive execution, UTC and a small shuffle width."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName("marlstone").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

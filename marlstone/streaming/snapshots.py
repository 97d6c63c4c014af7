"""An extension: snapshot folders as a stream, each batch merged into the listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(source, listing_id, price, observed_at) rows into one row a listing: first and last seen, times seen, newest price."""
    one = new.groupBy("source", "listing_id").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.count("*").alias("seen"), F.max_by("price", "observed_at").alias("price"))
    both = one if old is None else old.unionByName(one)
    return both.groupBy("source", "listing_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max_by("price", "last_seen_at").alias("price"), F.max("last_seen_at").alias("last_seen_at"), F.sum("seen").alias("seen"))


def stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Merges every new file of `source` into versions <target>/v=<batch>; a batch that is run again overwrites its own version.

    The version before stays for readers and for a batch that is run again; older ones go."""

    def sink(batch: DataFrame, epoch: int) -> None:
        old = spark.read.parquet(f"{target}/v={epoch - 1}") if epoch else None
        merged(old, batch).write.mode("overwrite").parquet(f"{target}/v={epoch}")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={epoch - 2}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    rows = spark.readStream.schema("source string, listing_id string, price double, observed_at timestamp").json(source)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

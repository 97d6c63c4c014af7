"""What every operator here shares: table access, the shared folder, shipping the package, bounded samples."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType
from pyspark.sql.window import Window

from marlstone.sources.shared import shared_dir, through_table
from marlstone.sources.tables import table

__all__ = ["bounded_sample", "free_names", "held_out", "shared_dir", "ship_package", "table", "through_table", "with_fields"]

#: Rows of an Arrow batch, where the session doesn't set spark.sql.execution.arrow.maxRecordsPerBatch.
RECORDS = 2000


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once per context, for functions that run in Python there.

    A session that doesn't say how many rows an Arrow batch has gets RECORDS: rows hold whole texts, and a batch lies
    outside the heap of an executor, which keeps memory of that size for each task."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))
    if getattr(sc, "_marlstone_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._marlstone_shipped = True


def bounded_sample(df: DataFrame, strata: list[str], key: list[Column], bound: int) -> DataFrame:
    """At most `bound` rows of each stratum: those of least hash of `key`, of rows with equal keys one, equal on every run.

    Rows of a hash far over the expected limit are passed over where they lie, so little is shuffled.
    Used for fitting only; every corpus statistic is computed over all rows."""
    hashed = F.pmod(F.xxhash64(F.lit(20240229), *key), F.lit(1 << 52))
    told = df.withColumn("_h", hashed)
    near = lambda n: F.col("_h") < F.lit(float(1 << 52)) * (4.0 * bound + 64) / n
    if strata:
        sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
        told = told.join(F.broadcast(sizes), strata).filter(near(F.col("_n"))).drop("_n")
    else:
        told = told.filter(near(F.lit(float(max(1, df.count())))))
    kept = [c for c in told.columns if c not in (*strata, "_h")]
    one = told.groupBy(*strata, "_h").agg(*(F.min(c).alias(c) for c in kept))
    if not strata:
        return one.orderBy("_h").limit(bound).drop("_h")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_h"))
    return one.withColumn("_r", rank).filter(F.col("_r") <= bound).drop("_h", "_r")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put behind those that `docs` has, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(docs: DataFrame, **added: DataType) -> StructType:
    """The schema of `docs` with more fields (name: type)."""
    return StructType([*docs.schema.fields, *(StructField(name, kind) for name, kind in added.items())])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model here may learn from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))

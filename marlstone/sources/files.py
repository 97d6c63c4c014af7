"""Readers and writers of listing files: CSV, JSON lines, snapshot folders, web archives, guarded outputs."""

from __future__ import annotations

import json
import plistlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headed CSV with quoted multi-line fields; a byte order mark and short or long rows are tolerated."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are dropped, unreadable ones become rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_snapshots(spark: SparkSession, root: str, rows: StructType | str, rows_name: str = "public-listings.jsonl", summary_name: str = "summary.json", complete: str = "snapshot_complete") -> DataFrame:
    """<root>/<snapshot>/<rows_name> with <root>/<snapshot>/<summary_name> (complete, collected_at) joined by folder name.

    A summary is one JSON document over any number of lines.  Rows without a source or listing_id are skipped."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("snapshot_id")
    summary = spark.read.schema(f"`{complete}` boolean, collected_at timestamp").json(f"{root}/*/{summary_name}", multiLine=True).select(F.col(complete).alias("complete"), "collected_at", name)
    return spark.read.schema(rows).json(f"{root}/*/{rows_name}").select("*", name).filter("source IS NOT NULL AND listing_id IS NOT NULL").join(summary, "snapshot_id", "left")


def rates_long(rates: DataFrame) -> DataFrame:
    """(date yyyyMMdd, usd_twd, eur_usd, usd_hkd, cny_twd) to long (date, currency, rate in TWD), cross rates derived, nulls dropped."""
    day = F.try_to_date(F.col("date"), "yyyyMMdd").alias("date")
    wide = rates.select(day, F.col("usd_twd").alias("USD"), (F.col("eur_usd") * F.col("usd_twd")).alias("EUR"), F.try_divide("usd_twd", "usd_hkd").alias("HKD"), F.col("cny_twd").alias("CNY"))
    return wide.unpivot("date", ["USD", "EUR", "HKD", "CNY"], "currency", "rate").filter("date IS NOT NULL AND rate IS NOT NULL")


def read_web_archives(spark: SparkSession, path: str, origin: str, mime: str, most_bytes: int = 20_000_000) -> DataFrame:
    """(path, url, body) of each binary web archive's main resource, or the reason for which it is refused."""

    def run(batches):
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                try:
                    main = plistlib.loads(content, fmt=plistlib.FMT_BINARY)["WebMainResource"]
                    url, kind, data = main["WebResourceURL"], main["WebResourceMIMEType"], main["WebResourceData"]
                    reason = None if url.startswith(origin) and kind == mime else "origin_or_type"
                    out.append((url, data.decode("utf-8", "replace") if reason is None else None, reason))
                except Exception:  # any malformed archive is one refused row
                    out.append((None, None, "unreadable"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([r[k] for r in out], pa.string()) for k in range(3))], names=["path", "url", "body", "reason"])

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes)
    return files.select("path", "content").mapInArrow(run, "path string, url string, body string, reason string")


def within(root: str, path: str) -> str:
    """`path` if it lies in `root` (neither may climb with ..), else ValueError."""
    whole = re.sub(r"/+$", "", path)
    if ".." in whole.split("/") or not f"{whole}/".startswith(re.sub(r"/*$", "/", root)):
        raise ValueError(f"{path} isn't inside {root}")
    return whole


def write_new(df: DataFrame, path: str) -> None:
    """Create-only: an existing target is an error."""
    df.write.mode("errorifexists").parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, at


def write_replaced(df: DataFrame, path: str, check: Callable[[DataFrame, DataFrame], None] | None = None) -> None:
    """Writes beside `path`, moves the old table aside, moves the new one in, then drops the old one.

    A failure at any point leaves a whole table at `path` or at <path>.old, which the next call puts back.
    check(old, new) may raise to refuse."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    target, beside, aside = at(path), at(f"{path}.new"), at(f"{path}.old")
    if fs.exists(aside) and not fs.exists(target):
        fs.rename(aside, target)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(target):
        try:
            if check:
                check(spark.read.parquet(path), spark.read.parquet(f"{path}.new"))
        except BaseException:
            fs.delete(beside, True)
            raise
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"{path} can't be moved")
    if not fs.rename(beside, target):
        raise OSError(f"{path}.new can't be moved")
    fs.delete(aside, True)


def write_not_smaller(df: DataFrame, path: str) -> None:
    """Replaces a table unless the new one has fewer rows; a failure or refusal leaves the old one."""

    def check(old: DataFrame, new: DataFrame) -> None:
        if new.count() < old.count():
            raise ValueError(f"{path} would shrink")

    write_replaced(df, path, check)


def checked_or_written(df: DataFrame, path: str, write: bool, writer: Callable[[DataFrame, str], None] = write_replaced) -> bool:
    """Whether `path` holds exactly these rows. With write: writes when it doesn't, replacing what is there."""
    try:
        old = df.sparkSession.read.parquet(path)
        same = sorted(old.dtypes) == sorted(df.dtypes) and old.select(df.columns).exceptAll(df).isEmpty() and df.exceptAll(old.select(df.columns)).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        same = False
    if write and not same:
        writer(df, path)
    return same


def write_snapshot(rows: DataFrame, root: str, snapshot_id: str, collected_at: str, complete: bool) -> None:
    """<root>/snapshots/<id>/ with the rows as JSON lines and a summary; <root>/latest.json names it only if it is complete.

    The folder is made of one write; the pointer is replaced by a rename, so a reader sees the old or the new one."""
    spark = rows.sparkSession
    at = within(f"{root}/snapshots", f"{root}/snapshots/{snapshot_id}")
    rows.write.mode("errorifexists").json(f"{at}/public-listings.jsonl")
    summary = {"snapshot_id": snapshot_id, "collected_at": collected_at, "snapshot_complete": complete, "rows": spark.read.text(f"{at}/public-listings.jsonl").count()}
    put_text(spark, f"{at}/summary.json", json.dumps(summary, indent=2) + "\n")
    if complete:
        put_text(spark, f"{root}/latest.json", json.dumps({"snapshot_id": snapshot_id}) + "\n")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced whole: written beside it and moved over it."""
    fs, at = _files(spark, path)
    out = fs.create(at(f"{path}.tmp"), True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at(path), False)
    if not fs.rename(at(f"{path}.tmp"), at(path)):
        raise OSError(f"{path} can't be written")


def backup_lines(entries: DataFrame, key: str, value: str, version: int, exported_at: str) -> DataFrame:
    """Sorted JSON lines of a backup: a head with version, time, entry count and digest, then an entry each.

    The digest is the sum of the entries' 64-bit hashes, so it is the same however the entries are spread."""
    each = F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")), {"ignoreNullFields": "false"})
    lines = entries.select(F.col(key).cast("string").alias("_k"), each.alias("line"))
    about = lines.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.xxhash64("line").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
    head = about.select(F.lit(0).alias("part"), F.lit("").alias("_k"), F.to_json(F.struct(F.lit(version).alias("version"), F.lit(exported_at).alias("exported_at"), "entries", "digest")).alias("line"))
    return head.unionByName(lines.select(F.lit(1).alias("part"), "_k", "line")).orderBy("part", "_k").select("line")


def stable_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """One compact JSON line a row, fields by name and rows by `order`: the same table always gives the same text."""
    return df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns))).alias("line"))


def read_json_document(spark: SparkSession, path: str, rows: StructType | str, at: str | None = None) -> DataFrame:
    """Rows of JSON documents over any number of lines: a list of objects, or the list under the field `at`.  A document
    that can't be read, or whose field isn't a list, gives no rows."""
    if at is None:
        return spark.read.schema(rows).json(path, multiLine=True, mode="DROPMALFORMED")
    kind = rows if isinstance(rows, str) else rows.simpleString().removeprefix("struct<").removesuffix(">")
    return spark.read.schema(f"`{at}` array<struct<{kind}>>" if ":" in kind.split(",")[0] else f"`{at}` array<struct<{', '.join(':'.join(c.strip().split(None, 1)) for c in kind.split(','))}>>").json(path, multiLine=True).select(F.inline(at))


def text_lines(rows: DataFrame, order: list, line: str) -> DataFrame:
    """One column `value`: the lines in order, the first with a byte order mark before it; what a text writer saves."""
    first = F.row_number().over(Window.orderBy(*order))  # a report's lines
    return rows.select(F.when(first == 1, F.concat(F.lit("﻿"), F.col(line))).otherwise(F.col(line)).alias("value"))

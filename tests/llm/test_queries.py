"""The queries with SQL against DuckDB, and the pipeline against its stages' definitions."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marlstone.llm import packing, registry
from tests.llm.test_linededup import brute as lines_brute
from tests.llm.test_ngramjoin import brute as join_brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(x) for x in want.select(*columns).fetchall()), key=repr)


def test_names():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = dict(corpus_pipeline.STAGES)
    good = kept["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    ids = {r.doc_id for r in good.collect()}
    right = [d for d, q in labels.items() if q == 1]
    assert sum(d in ids for d in right) / len(right) > 0.95
    known = kept["language ID"](spark, good, SF)
    assert known.columns == docs.columns and known.count() > 0.97 * good.count()
    cleaned = kept["line dedup"](spark, known, SF)
    assert cleaned.dtypes == docs.dtypes
    want = {d: t for d, (t, _, _) in lines_brute([(r.doc_id, r.text) for r in known.collect()]).items() if t}
    got = {r.doc_id: r for r in cleaned.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    single = kept["n-gram Jaccard join"](spark, cleaned, SF)
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in join_brute(list(want.items()), 5, 80).items() if c == d}
    packed = kept["best-fit packing"](spark, single, SF)
    import public_tokenizers as P

    tool = packing.encoding(P.path("byte_bpe_50k.json"), P.PATTERN)
    total = sum(len(tool.encode_ordinary(r.text)) + 1 for r in single.collect())
    rows = packed.collect()
    assert sum(r.length for r in rows) == total and len({r.sequence_id for r in rows}) <= total / 1024 * 1.1 + 1


def test_pipeline_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, None, "en", "s", 0, 3), (2, "x y z " * 9, "en", "s", 0, 4), (2, "x y z " * 9, "en", "s", 0, 4)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "best-fit packing" or out.columns == docs.columns
            out.count()


def test_pipeline_returns_clashing_columns_unchanged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400")
    names = ["score", "Predicted", "lang_pred", "rejected", "n_lines", "n_exact", "gone", "_text", "_b", "_kept", "c", "id"]
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, wide, SF), stage(spark, docs, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect()), name

import numpy as np
import pyarrow as pa

from marlstone.llm.runtime import ship_package
from marlstone.llm.textbatch import batches_of

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _sizes(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return [r["n"] for r in spark.range(0, 9000, 1, 1).mapInArrow(run, "n long").collect()]


def test_arrow_batches_are_small_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(KEY, None)
    try:
        spark.conf.unset(KEY)
        ship_package(spark)
        sizes = _sizes(spark)
        assert sum(sizes) == 9000 and max(sizes) <= 2000
        spark.conf.set(KEY, "3000")
        ship_package(spark)
        assert max(_sizes(spark)) == 3000
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def test_texts_are_looked_at_in_pieces_of_a_quarter_megabyte():
    offsets = np.arange(0, 4_000_001, 1000)
    cut = list(batches_of((np.zeros(4_000_000, np.uint8), offsets)))
    assert max(len(data) for _, data, _ in cut) <= 1 << 18
    assert [at for at, _, _ in cut][0] == 0 and sum(len(o) - 1 for _, _, o in cut) == 4000

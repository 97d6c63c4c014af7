from pyspark.sql import functions as F

from marlstone.llm import linededup


def test_few_rows_pass_the_buckets_by_chance(spark):
    keys, others, key = spark.range(300_000), spark.range(300_000, 600_000), F.col("id")
    assert linededup._among(keys, key, keys, key).count() == 300_000
    by_chance = linededup._among(others, key, keys, key).count()
    assert by_chance < 6_000  # with a row a bucket it was two of five
    assert linededup._among(others, key, keys, key, "left_anti").count() == 300_000 - by_chance

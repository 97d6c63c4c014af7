"""Price queries: outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators.robust import mad_outliers
from marlstone.sources.tables import table


def q_mad_outliers(spark, sf):
    out = mad_outliers(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderkey", "o_orderpriority", "n_group", F.round("robust_z", 6).alias("robust_z"), "is_outlier", F.concat_ws(",", "quality_flags").alias("flags"))


SQL_MAD = """
WITH l AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END AS lp FROM orders),
m AS (SELECT o_orderpriority, quantile_cont(lp, 0.5) AS med, count(*) AS n FROM l WHERE lp IS NOT NULL GROUP BY 1),
s AS (SELECT l.o_orderpriority, any_value(med) AS med, any_value(n) AS n, quantile_cont(abs(lp - med), 0.5) AS mad
      FROM l JOIN m USING (o_orderpriority) WHERE lp IS NOT NULL GROUP BY 1),
j AS (SELECT o_orderkey, l.o_orderpriority, lp, coalesce(n, 0) AS n, abs(lp - med) AS d, mad FROM l LEFT JOIN s USING (o_orderpriority)),
k AS (SELECT *, CASE WHEN lp IS NULL THEN TRUE WHEN n < 5 THEN FALSE WHEN mad > 0 THEN 0.6745 * d / mad > 5 ELSE d >= 2.302585092994046 END AS bad FROM j)
SELECT o_orderkey, o_orderpriority, CAST(n AS BIGINT) AS n_group,
       round(CASE WHEN n >= 5 AND mad > 0 THEN 0.6745 * d / mad END, 6) AS robust_z, coalesce(bad, FALSE) AS is_outlier,
       concat_ws(',', CASE WHEN lp IS NULL THEN 'invalid_price' END, CASE WHEN n < 5 THEN 'small_group' END, CASE WHEN bad THEN 'price_outlier' END) AS flags
FROM k
"""

QUERIES = {"mad_outliers": (q_mad_outliers, SQL_MAD)}

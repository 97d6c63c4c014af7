"""URL filtering by rules and, where no rule fits, by an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain (a label more than the suffix) and suffix (the
last label, or the last two where they are one of `second_level`, under which anyone may register).
Each level's beta prior has the mean of the level above and a strength fitted by moments over that level's entities:
the suffix shrinks to the whole table, the domain to its suffix, the host to its domain.  A page without a rule is
blocked where the lower posterior bound of its host's bad share (mean - z * sd) is over a limit.

Native: DataFrame and SQL functions only.  Counts are aggregated by host before anything else; a very common host makes
one heavy key only in the join back, which Spark splits at run time.

Cases: a null url or one without `://` has empty host and path, no rule, and the reputation of the empty host; rules are
literal, of two that fit the longer (host and path together) wins, then the smaller text; without labelled pages the
prior is 0.05 and nothing is blocked by reputation; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import through_table

#: (verdict, host, path): fixed by the query's contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Least share of bad pages, in the posterior's lower bound at Z deviations, that blocks a host.
LIMIT, Z = 0.3, 1.0
#: Suffixes of two labels, fixed values; a parameter where other registries matter.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.tr", "co.in", "co.kr", "co.za", "com.mx", "com.ar", "com.tw", "com.hk", "com.sg")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule's text (null if none fits) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _level(counts: DataFrame, key: str, parent: str | None) -> DataFrame:
    keys = [key] + [parent] * bool(parent)
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(level: DataFrame) -> float:
    """The prior's pseudo-count by the method of moments over a level's entities, within [0.5, 1000]."""
    k, n, squares, bad, ratios = level.filter("n > 0").agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
    if not k or k < 2:
        return 1000.0
    p = bad / n
    within = p * (1 - p)
    between = (ratios - n * p * p - (k - 1) * within) / (n - squares / n)
    return 1000.0 if between <= 0 else min(1000.0, max(0.5, within / between - 1))


def reputation(counts: DataFrame, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """From (host, n, bad), one row for each host: the posterior's alpha and beta. `counts` is read several times."""
    two = F.substring_index("host", ".", -2)
    wide = two.isin(*second_level) if second_level else F.lit(False)
    counts = counts.withColumn("suffix", F.when(wide, two).otherwise(F.substring_index("host", ".", -1))).withColumn("domain", F.when(wide, F.substring_index("host", ".", -3)).otherwise(two))
    suffix, domain = _level(counts, "suffix", None), _level(counts, "domain", "suffix")
    total, bad = suffix.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    p0 = (bad + 0.5) / (total + 10)
    ks, kd, kh = (_strength(x) for x in (suffix, domain, counts))
    s = suffix.select("suffix", ((F.col("bad") + ks * p0) / (F.col("n") + ks)).alias("p_suffix"))
    d = domain.join(s, "suffix").select("domain", ((F.col("bad") + kd * F.col("p_suffix")) / (F.col("n") + kd)).alias("p_domain"))
    return counts.join(d, "domain").select("host", "n", "bad", (F.col("bad") + kh * F.col("p_domain")).alias("alpha"), (F.col("n") - F.col("bad") + kh * (1 - F.col("p_domain"))).alias("beta"))


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    total = alpha + beta
    return alpha / total - F.lit(z) * F.sqrt(alpha * beta / (total * total * (total + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_bound of every row of `pages` (page_id, url).

    `outcomes` (item long, bad int) labels the pages that show item N, whose path is /<section>/N...; several outcomes
    of an item count as bad if one is."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    item = F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1), '') as bigint)")
    labelled = parsed.select("host", item.alias("item")).groupBy("host", "item").agg(F.count("*").alias("times"))
    known = outcomes.filter(F.col("item").isNotNull() & F.col("bad").isNotNull()).groupBy("item").agg(F.max("bad").alias("bad"))
    per_item = labelled.join(known, "item", "left")
    spread = per_item.select("host", F.when(F.col("bad").isNotNull(), F.col("times")).otherwise(0).alias("n"), (F.coalesce("bad", F.lit(0)) * F.col("times")).alias("bad"))
    # A row for each host, written once: the fits and the posterior read it, not the pages.
    counts = through_table(spread.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "host-counts")
    rep = reputation(counts, second_level)
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    bound = lower_bound(F.col("alpha"), F.col("beta"), z)
    return parsed.join(rep, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bound > limit, F.lit("block")).otherwise("allow")).alias("verdict"), F.round(bound, 6).alias("bad_bound"))

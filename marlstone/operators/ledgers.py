"""Ledgers and stores: reviewed patches, drafts, searches over tabs, names that may be shown, locked bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.filters import all_of, reason_cascade

# Grades that say too little, lengths of names shown and of names for sale, words of sets.
LOW_GRADE, SHOWN, FOR_SALE = "C", (2, 12), (2, 6)
COLLECTIVE = "套組|組合|耳尾組|三件套|全圖|熱門復刻"
#: How long a draft is kept, and how far a clock may run ahead. Fixed values.
KEPT, AHEAD = "30 days", "5 minutes"
FREE_STATUS = ("transferable", "unbound")


def reviewed_patches(rows: DataFrame, patches: DataFrame, digest: str, allowed: dict[str, tuple[str, ...]], excludes: str = "exclude_from_model") -> DataFrame:
    """Each patch (post_key, field, value, quote, reason, source_digest) with `result`: applied, or why not.

    rows: (post_key, summary, reviewed_fields: array, and the fields as strings).  A patch needs the digest of the reviewed
    source, one row, a quote that stands in its summary and a reason; it may add an exclusion, or fill a field that is
    null and not reviewed with an allowed value.  Two patches of one field of a row are both refused."""
    fields = [c for c in allowed if c in rows.columns]
    known = F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in fields))) if fields else F.create_map()
    told = rows.groupBy(F.col("post_key").alias("_p")).agg(F.count("*").alias("_n"), F.any_value("summary").alias("_s"), F.any_value(F.coalesce("reviewed_fields", F.array().cast("array<string>"))).alias("_r"), F.any_value(known).alias("_k"))
    times = patches.groupBy(F.col("post_key").alias("_q"), F.col("field").alias("_f")).agg(F.count("*").alias("_times"))
    p = patches.join(told, F.col("post_key") == F.col("_p"), "left").join(times, (F.col("post_key") == F.col("_q")) & (F.col("field") == F.col("_f")), "left")
    may = F.lit(False)
    for field, values in allowed.items():
        may = may | ((F.col("field") == field) & F.col("value").isin(*values))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    exclusion = F.col("field") == excludes
    why = reason_cascade([
        ("source_digest_mismatch", no(F.col("source_digest") == digest)), ("missing_or_duplicate_row", no(F.col("_n") == 1)), ("duplicate_patch", F.coalesce(F.col("_times"), F.lit(2)) > 1),
        ("quote_not_found", ~filled("quote") | no(F.contains("_s", "quote"))), ("reason_required", ~filled("reason")), ("only_exclusions_may_be_added", exclusion & no(F.col("value") == "true")),
        ("invalid_feature", no(exclusion) & no(may)), ("already_known_or_reviewed", no(exclusion) & (F.try_element_at("_k", "field").isNotNull() | F.array_contains("_r", F.col("field")))),
    ])
    return p.withColumn("result", F.coalesce(why, F.lit("applied"))).drop("_p", "_n", "_s", "_r", "_k", "_q", "_f", "_times")


def newest_drafts(drafts: DataFrame, owner: str, key: str, keys: tuple[str, ...], saved_at: str, now: Column, readable: Column) -> DataFrame:
    """Each owner's draft under the first of `keys` (newest first) that can be read and is neither expired nor ahead of the
    clock; `moved` says whether it stood under an older key."""
    place = F.array_position(F.array(*(F.lit(k) for k in keys)), F.col(key))
    fits = drafts.filter(F.coalesce(readable, F.lit(False)) & (place > 0) & (F.col(saved_at) >= now - F.expr(f"interval {KEPT}")) & (F.col(saved_at) <= now + F.expr(f"interval {AHEAD}")))
    order = F.struct(place, F.col(saved_at))
    return fits.groupBy(owner).agg(F.min_by(F.struct(*(c for c in drafts.columns if c != owner)), order).alias("d")).select(owner, "d.*").withColumn("moved", F.col(key) != keys[0])


def searched(items: DataFrame, query: str, tab: Column, closet: Column, text: list[str], *filters: Column | None) -> DataFrame:
    """Items of the tab, or with a query that isn't blank those of all closets whose search text has it; filters hold for both."""
    wanted = query.strip().lower()
    index = F.lower(F.concat_ws(" ", *text))
    return items.filter(all_of([closet & F.contains(index, F.lit(wanted)) if wanted else tab, *filters]))


def shown_names(names: DataFrame, term: str, grade: str) -> DataFrame:
    """`names` with shown and for_sale: the term where it may stand for its item: not of a low grade, of fitting length, and,
    to be shown, of one row alone and no set's name."""
    times = names.groupBy(F.col(term).alias("_t")).agg(F.count("*").alias("_n"))
    good = F.coalesce(F.col(grade) != LOW_GRADE, F.lit(True))
    size = F.length(term)
    shown = good & size.between(*SHOWN) & ~F.col(term).rlike(COLLECTIVE) & (F.col("_n") == 1)
    return names.join(times, F.col(term) == F.col("_t"), "left").withColumns({"shown": F.when(shown, F.col(term)), "for_sale": F.when(good & size.between(*FOR_SALE), F.col(term))}).drop("_t", "_n")


def locked(features: Column) -> Column:
    """How many bindings of a map of features are known and neither transferable nor unbound."""
    return F.size(F.map_filter(features, lambda k, v: k.startswith("binding:") & v.isNotNull() & ~v.isin(*FREE_STATUS)))

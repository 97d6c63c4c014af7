"""Saved gift pages: their packages as rows, the prices that they show, and whether their members are one known package.

Cases: a page whose declared count isn't that of its packages, or is none or over MOST, is one row with a reason; a package
without members is unknown; an icon without a catalog item makes its package unknown.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.pages import html_rows

#: Packages of a page at most, currencies of symbols that establish one, and words of a name that is a package's. Fixed values.
MOST = 1000
CURRENCIES = (("NT$", "TWD"), ("US$", "USD"), ("$", None), ("¥", None), ("₫", "VND"))
PACKAGE_WORDS = "禮包|套組|套裝"


def gift_packages(pages: DataFrame) -> DataFrame:
    """From (page, html): a row for each package (page, place, name, price_text, extras, icons), or one with a reason for a
    page that can't be trusted."""
    fields = {"name": ".nm", "price": ".pr", "more": ".g-extras", "icons": ".g-unlocks img@alt"}
    rows = html_rows(pages.select(F.col("page").cast("string"), "html"), "page", "html", "#gl .g-item", fields, {"declared": "#gc"})
    count = F.trim(F.array_join("declared", ""))
    sound = F.coalesce(count.rlike("^[0-9]+$") & (count.try_cast("long") == F.col("of")) & F.col("of").between(1, MOST), F.lit(False))
    text = lambda c: F.when(sound, F.trim(F.array_join(c, "")))
    told = rows.select("page", F.coalesce("place", F.lit(1)).alias("_at"), F.when(sound, F.col("place")).alias("place"), text("name").alias("name"), text("price").alias("price_text"), text("more").alias("extras"), F.when(sound, F.col("icons")).alias("icons"), F.when(~sound, "incomplete").alias("reason"))
    return told.filter("reason IS NULL OR _at = 1").drop("_at")


def displayed_prices(text: Column) -> Column:
    """An array of struct(symbol, currency, amount): prices shown for reference; a bare $ or ¥ names no currency.

    What follows a symbol is read as one run of digits, commas and points, and counts only if it is a well-formed number."""
    shown = "(" + "|".join(re.escape(symbol) for symbol, _ in CURRENCIES) + r")\s*([0-9.,]+)"
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(shown), F.lit(k)).alias(name) for k, name in ((1, "symbol"), (2, "run"))))
    whole = F.filter(found, lambda p: p["run"].rlike(r"^[0-9]+(,[0-9]{3})*([.][0-9]+)?$"))
    names = F.create_map(*(F.lit(x) for pair in CURRENCIES if pair[1] for x in pair))
    return F.transform(whole, lambda p: F.struct(p["symbol"].alias("symbol"), F.try_element_at(names, p["symbol"]).alias("currency"), F.replace(p["run"], F.lit(",")).cast("double").alias("amount")))


def package_status(packages: DataFrame, icons: DataFrame, catalog: DataFrame) -> DataFrame:
    """`packages` with members, status, package_key and name_item (the item that a one-item package names).

    icons: (icon, guid); catalog: (guid, paid, package_key). A package is exact if its members are all paid and are all
    that the catalog has of one package."""
    usable = packages.filter("reason IS NULL").withColumn("id", F.struct("page", "place"))
    each = usable.select("id", F.explode_outer(F.array_distinct("icons")).alias("icon"))
    known = each.join(icons, "icon", "left").join(catalog, "guid", "left")
    whole = catalog.filter("package_key IS NOT NULL").groupBy("package_key").agg(F.array_sort(F.collect_set("guid")).alias("whole"))  # one package's items
    got = known.groupBy("id").agg(F.array_sort(F.collect_list("guid")).alias("members"), F.bool_and(F.coalesce("paid", F.lit(False))).alias("known"), F.collect_set("package_key").alias("keys"))
    got = got.withColumn("key", F.when(F.size("keys") == 1, F.get("keys", F.lit(0)))).join(whole, F.col("key") == F.col("package_key"), "left")
    exact = F.coalesce(F.col("known") & (F.col("members") == F.col("whole")), F.lit(False))
    told = got.select("id", "members", F.when(~F.col("known"), "unknown-member").when(exact, "exact-members").otherwise("review-package-members").alias("status"), F.when(exact, F.col("key")).alias("package_key"))
    one = (F.col("status") == "exact-members") & (F.size("members") == 1) & (F.col("name") != "") & ~F.col("name").rlike(PACKAGE_WORDS)
    return usable.join(told, "id").withColumn("name_item", F.when(one, F.get("members", F.lit(0)))).drop("id", "reason")

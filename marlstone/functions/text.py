"""Text and number expressions."""

from __future__ import annotations

import unicodedata
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def redact(text: Column) -> Column:
    """E-mail addresses, card-like and telephone-like digit runs become placeholders, in this order."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"[0-9]{13,19}", "[number]")
    return F.regexp_replace(out, r"\(?\+?[0-9]{1,3}\)?[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -]?[0-9]{4}", "[phone]")


def localized_number(text: Column) -> Column:
    """The last comma or point is a decimal mark only before one or two digits at the end; all others group thousands."""
    decimal = text.rlike("[.,][0-9]{1,2}$")
    whole = F.regexp_replace(F.when(decimal, F.regexp_replace(text, "[.,][0-9]{1,2}$", "")).otherwise(text), "[.,]", "")
    part = F.when(decimal, F.regexp_extract(text, "[.,]([0-9]{1,2})$", 1)).otherwise("0")
    return F.concat(whole, F.lit("."), part).try_cast("double")


def unit_scaled(text: Column) -> Column:
    """A number with an optional ten-thousands unit (w), rounded; a decimal under 100 without unit is in ten thousands too."""
    number = F.nullif(F.regexp_extract(text, "^([0-9]+(\\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    scaled = text.endswith("w") | (text.contains(".") & (number < 100))
    return F.round(F.when(scaled, number * 10000).otherwise(number))


def round_price(price: Column) -> Column:
    """To hundreds from 10,000 on, to tens from 1,000 on, else to ones; at least 1. Null or not positive: null."""
    unit = F.when(price >= 10000, 100.0).when(price >= 1000, 10.0).otherwise(1.0)
    return F.when(price > 0, F.greatest(F.lit(1.0), F.floor(price / unit + 0.5) * unit))


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


#: Names that Windows reserves, whatever follows the first point; what an empty and what a reserved name gets. Fixed values.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{x}{k}" for x in ("COM", "LPT") for k in range(1, 10)))
UNNAMED, ACCOUNT = "未命名", "-帳號"


def safe_name(text: Column) -> Column:
    """A portable file name: control and illegal characters become -, outer blanks and trailing points go."""
    out = F.regexp_replace(F.trim(F.regexp_replace(text, r'[\x00-\x1F\x7F\\/:*?"<>|]', "-")), "[. ]+$", "")
    base = F.upper(F.substring_index(out, ".", 1))
    return F.when(out == "", UNNAMED).when(base.isin(*RESERVED), F.concat(out, F.lit(ACCOUNT))).otherwise(out)


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of character bigrams; containment lifts it to 0.82, or 0.78 under 4 characters."""
    def grams(x):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(2))))
    dice = 2.0 * F.size(F.array_intersect(grams(a), grams(b))) / (F.size(grams(a)) + F.size(grams(b)))
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(inside, F.greatest(dice, F.when(F.least(F.length(a), F.length(b)) >= 4, 0.82).otherwise(0.78))).otherwise(dice)


def nfkc(text: Column) -> Column:
    """Unicode compatibility form, for which there is no built-in; plain ASCII texts never leave the JVM."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return F.coalesce(F.pandas_udf(run, StringType())(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize(text: Column) -> Column:
    """NFKC, lower case, no white space."""
    return F.regexp_replace(F.lower(nfkc(text)), r"(?U)\s+", "")


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Relative luminance of 8-bit sRGB."""
    def linear(c):
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(red) + 0.7152 * linear(green) + 0.0722 * linear(blue)


def anniversary(text: Column, first_year: int = 2019) -> Column:
    """The number of an ordinal, else the years that a year after the first one is away from it."""
    nth = F.nullif(F.regexp_extract(text, "([0-9]+)(st|nd|rd|th)", 1), F.lit("")).try_cast("long")
    year = F.nullif(F.regexp_extract(text, "(20[0-9]{2})", 1), F.lit("")).try_cast("long")
    return F.coalesce(nth, F.when(year > first_year, year - first_year))


#: Unicode's fractions, fixed values: (parts, of) to sign.
FRACTIONS = {(1, 4): "¼", (1, 2): "½", (3, 4): "¾", (1, 3): "⅓", (2, 3): "⅔", (1, 5): "⅕", (2, 5): "⅖", (3, 5): "⅗", (4, 5): "⅘", (1, 6): "⅙", (5, 6): "⅚", (1, 8): "⅛", (3, 8): "⅜", (5, 8): "⅝", (7, 8): "⅞"}


def fraction(parts: Column, of: int) -> Column:
    """parts / of as a whole number and a fraction sign; a part without a sign is written out."""
    whole, rest, label = F.floor(parts / of), parts % of, F.lit("")
    for k in range(1, of):
        g = gcd(k, of)
        label = F.when(rest == k, FRACTIONS.get((k // g, of // g), f" {k // g}/{of // g}")).otherwise(label)
    return F.when((whole == 0) & (rest > 0), F.trim(label)).otherwise(F.concat(whole.cast("string"), label))


def lua_records(text: Column) -> Column:
    """An array of maps, one for each innermost {...} of a Lua table: its quoted or bare fields."""
    records = F.regexp_extract_all(text, F.lit(r"\{([^{}]*)\}"), F.lit(1))
    field = r"""([A-Za-z_]\w*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s,;}"']+))"""
    def fields(r: Column) -> Column:
        names, a, b, c = (F.regexp_extract_all(r, F.lit(field), F.lit(k)) for k in (1, 2, 3, 4))
        pairs = F.transform(F.arrays_zip(names.alias("k"), a.alias("a"), b.alias("b"), c.alias("c")), lambda x: F.struct(x["k"].alias("k"), F.regexp_replace(F.concat(x["a"], x["b"], x["c"]), r"\\(.)", "$1").alias("v")))
        last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
        return F.map_from_entries(last)
    return F.filter(F.transform(records, fields), lambda m: F.size(m) > 0)

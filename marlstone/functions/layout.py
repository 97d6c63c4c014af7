"""Texts and boxes laid out in rows and pages: wrapped names, progress tokens, flowing boxes, page ends.

All are column expressions over one account's lists; a null list gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.marks import let
from marlstone.functions.text import FRACTIONS

# Names and characters of a row, what joins them; progress tokens of a row, their joint, all done and none.
MOST_NAMES, MOST_LENGTH, NAME_JOINT = 4, 20, "・"
TOKENS, TOKEN_JOINT, DONE, NONE = 4, "｜", "畢", "⁰"
SIGNS = FRACTIONS | {(1, 7): "⅐", (1, 9): "⅑", (1, 10): "⅒"}


def wrapped(names: Column, most: int = MOST_NAMES, length: int = MOST_LENGTH, joint: str = NAME_JOINT) -> Column:
    """Rows of names: a row ends before a name that would be one too many or make it longer than `length` characters."""
    start = F.struct(F.array().cast("array<string>").alias("rows"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, name: Column) -> Column:
        longer = F.concat(acc["now"], F.lit(joint), name)
        full = (acc["n"] > 0) & ((acc["n"] >= most) | (F.length(longer) > length))
        fresh = acc["n"] == 0
        return F.struct(
            F.when(full, F.concat(acc["rows"], F.array(acc["now"]))).otherwise(acc["rows"]).alias("rows"),
            F.when(full | fresh, name).otherwise(longer).alias("now"),
            F.when(full, 1).otherwise(acc["n"] + 1).alias("n"),
        )

    return F.aggregate(names, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["rows"], F.array(acc["now"]))).otherwise(acc["rows"]))


def progress_rows(seasons: Column, tokens: int = TOKENS) -> Column:
    """From an array of struct(name, owned, total) in order: rows of progress tokens, from the first season of which
    something is owned; seasons whose numbers can't be are left out."""
    valid = F.filter(seasons, lambda s: (s["total"] > 0) & (s["owned"] >= 0) & (s["owned"] <= s["total"]))
    ratio = lambda s: F.concat_ws("/", s["owned"].cast("string"), s["total"].cast("string"))
    signs = F.create_map(*(F.lit(x) for (a, b), sign in SIGNS.items() for x in (f"{a}/{b}", sign)))
    token = lambda s: F.concat(s["name"], F.when(s["owned"] == 0, NONE).when(s["owned"] == s["total"], DONE).otherwise(F.coalesce(F.try_element_at(signs, ratio(s)), ratio(s))))

    def cut(v: Column) -> Column:
        first = F.array_position(F.transform(v, lambda s: s["owned"] > 0), True)
        return F.when(first > 0, let(F.transform(F.slice(v, first.cast("int"), F.size(v)), token), rows)).otherwise(F.array().cast("array<string>"))

    def rows(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(all_) - 1) / tokens).cast("int"))
        return F.transform(starts, lambda k: F.array_join(F.slice(all_, k * tokens + 1, tokens), TOKEN_JOINT))

    return let(valid, cut)


def flowed(boxes: Column, width: float, gap: float) -> Column:
    """From an array of struct(w, h): struct(places: array of struct(x, y), height): boxes from left to right, a new row where
    the next one doesn't fit, each row as high as its highest box."""
    start = F.struct(F.array().cast("array<struct<x:double,y:double>>").alias("places"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("high"))

    def step(acc: Column, box: Column) -> Column:
        w, h = F.least(box["w"].cast("double"), F.lit(float(width))), box["h"].cast("double")
        turn = (acc["x"] > 0) & (acc["x"] + w > width)
        x, y = F.when(turn, 0.0).otherwise(acc["x"]), F.when(turn, acc["y"] + acc["high"] + gap).otherwise(acc["y"])
        return F.struct(F.concat(acc["places"], F.array(F.struct(x.alias("x"), y.alias("y")))).alias("places"), (x + w + gap).alias("x"), y.alias("y"), F.when(turn, h).otherwise(F.greatest(acc["high"], h)).alias("high"))

    return F.aggregate(boxes, start, step, lambda acc: F.struct(acc["places"].alias("places"), F.when(F.size(acc["places"]) > 0, acc["y"] + acc["high"]).otherwise(0.0).alias("height")))


def pages(breakpoints: Column, total: Column, limit: float) -> Column:
    """An array of struct(offset, height): pages of at most `limit`, each ending at the largest breakpoint that fits, or at
    the limit where none does."""
    start = F.struct(F.array().cast("array<struct<offset:double,height:double>>").alias("pages"), F.lit(0.0).alias("at"))
    whole = total.cast("double")

    def step(acc: Column, _: Column) -> Column:
        most = F.least(acc["at"] + limit, whole)
        fits = F.array_max(F.filter(breakpoints, lambda p: (p > acc["at"]) & (p <= most))).cast("double")
        return let(F.struct(F.coalesce(fits, most).alias("end"), acc.alias("acc")), lambda x: F.when(x["acc"]["at"] < whole, F.struct(F.concat(x["acc"]["pages"], F.array(F.struct(x["acc"]["at"].alias("offset"), (x["end"] - x["acc"]["at"]).alias("height")))).alias("pages"), x["end"].alias("at"))).otherwise(x["acc"]))

    rounds = F.sequence(F.lit(0), F.size(breakpoints) + F.ceil(whole / limit).cast("int"))
    return F.aggregate(rounds, start, step, lambda acc: acc["pages"])

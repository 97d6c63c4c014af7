"""How a listing's text is laid out: numbered offers, sections with a heading, marked blocks, offers of data alone.

All are column expressions over normalised text (see `functions.marks`); a null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.marks import let

# Heads of numbered offers (the digits' keycaps, points and brackets, and dingbats).
HEAD = "^(?:[0-9]{1,2}(?:️?⃣|[.、:：)])|[①②③④⑤⑥⑦⑧⑨⑩]|[❶❷❸❹❺❻❼❽❾❿])\\s*"
# Headings of sections that aren't the account's own inventory.
GIFTED = r"^[^\p{L}\p{N}]*(?:贈號上數據|赠号上数据)\s*[:：]?\s*$"
PHYSICAL = r"(?i)^[^\p{L}\p{N}]*(?:實體|实体)\s*(?:star\s*)?徽章\s*[:：]?\s*$"
# An account that isn't part of the offer, what is offered then, and what denies it.
NO_ACCOUNT, DATA, DENIED = "(?:無|无|沒有|没有)(?:帳號|账号)?本[體体]", "數據|数据", "(?:不是|並非|并非|非)$"
# A marked price, prices that are floors or one of several ways, what is sold along, fees.
MARKED_PRICE = r"(?i)(\d+(?:\.\d+)?)\s*(w|萬)?\s*(?:ntd|twd|台幣)"
NOT_ONE_PRICE, SOLD_ALONG, WITH_FEES = r"NTD\s*底|底價|起標|\d+\s*直出", "買就送無翼|合售|贈號|送號", "包仲介|包仲"


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def bare(text: Column) -> Column:
    """Without outer white space."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def numbered_offers(text: Column) -> Column:
    """The offers of a post: with two numbered heads or more, a text for each, the head taken off and what stands before the
    first one put in front; else the post as it is."""

    def cut(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x).rlike(HEAD), i)), lambda i: i.isNotNull())
        return let(F.struct(lines.alias("lines"), at.alias("at")), told)

    def told(x: Column) -> Column:
        lines, at = x["lines"], x["at"]
        prefix = bare(F.array_join(F.slice(lines, F.lit(1), F.get(at, F.lit(0))), "\n"))

        def offer(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(lines))
            first = F.regexp_replace(F.ltrim(F.get(lines, start)), HEAD, "")
            body = F.array_join(F.concat(F.array(first), F.slice(lines, start + 2, end - start - 1)), "\n")
            return bare(F.concat_ws("\n", F.nullif(prefix, F.lit("")), F.nullif(body, F.lit(""))))

        several = F.filter(F.transform(at, offer), lambda t: t != "")
        return F.when(F.size(at) < 2, F.array(F.array_join(lines, "\n"))).otherwise(several)

    return F.when(text.isNotNull(), let(lines_of(bare(text)), cut))


def inventory_sections(text: Column) -> Column:
    """struct(inventory, separate_account, physical_collectibles): the lines of each; a heading opens a section, which ends
    before the next blank line; headings belong to none."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("s0"), empty.alias("s1"), empty.alias("s2"))

    def step(acc: Column, line: Column) -> Column:
        heading = F.when(line.rlike(GIFTED), 1).when(line.rlike(PHYSICAL), 2)
        at = F.coalesce(heading, F.when(F.trim(line) == "", 0), acc["at"])
        put = lambda k: F.when(heading.isNull() & (at == k), F.concat(acc[f"s{k}"], F.array(line))).otherwise(acc[f"s{k}"])
        return F.struct(at.alias("at"), *(put(k).alias(f"s{k}") for k in range(3)))

    names = ("inventory", "separate_account", "physical_collectibles")
    return F.when(text.isNotNull(), F.aggregate(lines_of(text), start, step, lambda acc: F.struct(*(F.array_join(acc[f"s{k}"], "\n").alias(n) for k, n in enumerate(names)))))


def data_only(text: Column) -> Column:
    """Whether an offer is of data without an account, and that isn't denied in front of it."""
    close = F.regexp_replace(text, r"(?U)\s+", "")
    before = F.regexp_extract(close, f"(?s)^(.*?){NO_ACCOUNT}", 1)
    return close.rlike(NO_ACCOUNT) & close.rlike(DATA) & ~before.rlike(DENIED)


def between(text: Column, start: str, end: str) -> Column:
    """What stands behind the first `start`, up to the next `start` or `end`; empty without one."""
    return F.substring_index(F.coalesce(F.get(F.split(text, start, -1), F.lit(1)), F.lit("")), end, 1)


def marked_offer(text: Column, title: Column) -> Column:
    """struct(title, price_text, price, excluded, price_basis) of a document with marked blocks: its title line (▍) or else
    the given title, the block of prices (♧ to ◇), the price if it is the only one, whether it can't be used, and
    whether fees are in it."""
    block = between(text, "♧", "◇")
    own = F.get(F.filter(lines_of(text), lambda x: F.contains(x, F.lit("▍"))), F.lit(0))
    numbers, units = (F.regexp_extract_all(block, F.lit(MARKED_PRICE), F.lit(k)) for k in (1, 2))
    prices = F.array_distinct(F.transform(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda p: p["n"].cast("double") * F.when(p["u"] == "", 1).otherwise(10_000)))
    one = F.when(F.size(prices) == 1, F.get(prices, F.lit(0)))
    excluded = one.isNull() | block.rlike(NOT_ONE_PRICE) | text.rlike(SOLD_ALONG)
    return F.when(text.isNotNull(), F.struct(F.coalesce(own, title).alias("title"), block.alias("price_text"), one.alias("price"), excluded.alias("excluded"), F.when(block.rlike(WITH_FEES), "including_fees").otherwise("unknown").alias("price_basis")))

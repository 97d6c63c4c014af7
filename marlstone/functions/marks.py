"""Marking: words of a small language become one sign each, so that what is claimed can be read off short patterns of signs.

Texts are in lower case, so capital letters are free as signs; lists of names get signs of their own from the private use
area, in the order of the list.  Every step is a linear pass in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import nfkc

_FIRST = 0xE000


def normalised(text: Column) -> Column:
    """NFKC, no outer blanks."""
    return F.trim(nfkc(text))


def compact(text: Column) -> Column:
    """NFKC, lower case, no white space; a null is empty."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"(?U)\s+", "")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def marked(text: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    """The text with the words of each (sign, pattern) replaced by the sign, in this order."""
    for sign, words in marks:
        text = F.regexp_replace(text, words, sign)
    return text


def names_marked(text: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """The text with the words of the kth (name, pattern) replaced by the kth private sign."""
    return marked(text, tuple((chr(_FIRST + k), words) for k, (_, words) in enumerate(names)))


def signs_of(names: tuple) -> str:
    """A character class of the signs of a list of names."""
    return f"[{chr(_FIRST)}-{chr(_FIRST + len(names) - 1)}]"


def name_of(sign: Column, names: tuple) -> Column:
    """The name whose private sign this is."""
    return F.get(F.array(*(F.lit(n[0]) for n in names)), F.ascii(sign) - _FIRST)


def matches(text: Column, pattern: str, *names: str) -> Column:
    """An array of structs: of each match the named groups, from 1 on (empty where a group takes no part)."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(name) for k, name in enumerate(names, 1)))


def single(found: Column) -> Column:
    """The only different value of an array, or null."""
    return let(F.array_distinct(found), lambda d: F.when(F.size(d) == 1, F.get(d, F.lit(0))))

"""HTML as rows: a streaming stack of open tags, simple selectors, and values of the elements that match.

A selector is a chain of parts with blanks between (each part inside the one before, at any depth); a part is a tag name,
#id and .classes in any combination.  A field is a selector, with @name behind it for an attribute instead of the text.
Nothing is fetched or run; an element that isn't closed ends with the one around it.

Cases: a null page is an empty one; a page without rows gives one row with a null place; a field without a match is an
empty list; a missing attribute is an empty string.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def compiled(selector: str) -> tuple[list[tuple[str, str, frozenset[str]]], str]:
    """The parts (tag, id, classes) of a field, and its attribute."""
    path, _, attribute = selector.partition("@")
    parts = []
    for part in path.split():
        if not re.fullmatch(r"[\w*-]*(?:[#.][\w-]+)*", part):
            raise ValueError(f"not a simple selector: {part}")
        names = re.findall(r"([#.]?)([\w-]+)", part)
        one = lambda sign, names=names: [n for s, n in names if s == sign]
        parts.append(("".join(one("")[:1]), "".join(one("#")[:1]), frozenset(one("."))))
    return parts, attribute


def _fits(part: tuple, tag: str, ident: str, classes: frozenset[str]) -> bool:
    return part[0] in ("", tag) and part[1] in ("", ident) and part[2] <= classes


class Scan(HTMLParser):
    """Rows: for each element that `each` selects, the values of its fields; page: those of the page's own fields."""

    def __init__(self, each: str, fields: list[str], page_fields: list[str]) -> None:
        super().__init__()
        self.each, self.fields, self.page_fields = compiled(each)[0], [compiled(f) for f in fields], [compiled(f) for f in page_fields]
        self.open: list[tuple[str, str, frozenset[str]]] = []
        self.rows: list[list[list[str]]] = []
        self.page: list[list[str]] = [[] for _ in page_fields]
        self.inside: list[tuple[int, list[list[str]]]] = []  # open rows: depth, values
        self.reading: list[tuple[int, list[str], int]] = []  # open texts: depth, where to, which

    def _selected(self, parts: list, above: int) -> bool:
        """Whether the innermost open element is selected, by elements over depth `above` alone."""
        if not parts or not _fits(parts[-1], *self.open[-1]):
            return False
        left = parts[:-1]
        for element in self.open[-2 : above - len(self.open) - 1 : -1] if above else self.open[-2::-1]:
            if left and _fits(left[-1], *element):
                left = left[:-1]
        return not left

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        self.open.append((tag, a.get("id", ""), frozenset(a.get("class", "").split())))
        depth = len(self.open)
        for values, fields, above in ((self.page, self.page_fields, 0), *((v, self.fields, d) for d, v in self.inside)):
            for value, (parts, attribute) in zip(values, fields, strict=True):
                if self._selected(parts, above):
                    value.append(a.get(attribute, "") if attribute else "")
                    if not attribute:
                        self.reading.append((depth, value, len(value) - 1))
        if self._selected(self.each, 0):
            own = [[a.get(attribute, "")] if attribute and not parts else [] for parts, attribute in self.fields]
            self.rows.append(own)
            self.inside.append((depth, own))
        if tag in VOID:
            self._close(depth)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k + 1)
                return

    def _close(self, depth: int) -> None:
        del self.open[depth - 1 :]
        self.inside = [x for x in self.inside if x[0] < depth]
        self.reading = [x for x in self.reading if x[0] < depth]

    def handle_data(self, data: str) -> None:
        for _, value, k in self.reading:
            value[k] += data


def html_rows(pages: DataFrame, key: str, html: str, each: str, fields: dict[str, str], page_fields: dict[str, str] | None = None) -> DataFrame:
    """A row for each element of a page that `each` selects: the key, place (from 1), of (how many the page has), the fields
    and page fields, each the list of the values of all elements that its selector selects inside the row (the page). A
    field of an attribute alone (@href) is the row's own."""
    page_fields = page_fields or {}
    names = [*fields, *page_fields]
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            which, place, of, values = [], [], [], [[] for _ in names]
            for k, text in enumerate(batch.column(1).to_pylist()):
                scan = Scan(each, list(fields.values()), list(page_fields.values()))
                scan.feed(text or "")
                scan.close()
                for at, row in enumerate(scan.rows or [[[] for _ in fields]], 1):
                    which.append(k)
                    place.append(at if scan.rows else None)
                    of.append(len(scan.rows))
                    for column, value in zip(values, [*row, *scan.page], strict=True):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(place, pa.int32()), pa.array(of, pa.int32()), *(pa.array(v, pa.list_(pa.string())) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "place", "of", *names])

    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, ", ".join([f"`{key}` {kind}, place int, of int", *(f"`{n}` array<string>" for n in names)]))


def query_value(url: Column, name: str) -> Column:
    """The (decoded) value of a url's query parameter, relative urls too; null without one."""
    raw = F.nullif(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def shown_text(values: Column) -> Column:
    """The first value with blanks joined, or null."""
    return F.trim(F.regexp_replace(F.get(values, F.lit(0)), r"(?U)\s+", " "))

"""Named records of a nested table notation: name = { field = "text", inner = { ... } }, one row for each.

A record starts where a line begins with a name, = and {.  Its end is found by counting braces outside of quoted
strings; all its quoted fields are taken, inner ones too, the last of a name counts.  A record that never ends is left
out; a later record of a text with the same name replaces an earlier one.

Cases: a null text has no records; records inside records have no row of their own unless their line starts with a name.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_START = re.compile(r"^[^\S\n]*([A-Za-z]\w*)\s*=\s*\{", re.M)
#: What matters inside: an escaped sign, a quote, a brace.
_SIGN = re.compile(r"\\.|[\"'{}]", re.S)
_FIELD = re.compile(r"\b([A-Za-z]\w*)\s*=\s*(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)')", re.S)


def closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at `at`, or -1."""
    depth, quote = 0, ""
    for m in _SIGN.finditer(text, at):
        sign = m.group()
        if quote:
            quote = "" if sign == quote else quote
        elif sign in ("'", '"'):
            quote = sign
        elif sign == "{":
            depth += 1
        elif sign == "}":
            depth -= 1
            if not depth:
                return m.start()
    return -1


def records(text: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for m in _START.finditer(text):
        end = closing(text, m.end() - 1)
        if end >= 0:
            inner = text[m.end() : end]
            out[m.group(1)] = {f.group(1): re.sub(r"\\(.)", r"\1", f.group(2) if f.group(2) is not None else f.group(3)) for f in _FIELD.finditer(inner)}
    return out


def named_records(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, record and fields (map) of every named record."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            which, names, fields = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for name, found in records(t or "").items():
                    which.append(k)
                    names.append(name)
                    fields.append(list(found.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(names, pa.string()), pa.array(fields, pa.map_(pa.string(), pa.string()))], names=[key, "record", "fields"])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, record string, fields map<string,string>")

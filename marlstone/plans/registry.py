"""All registered queries of the library: name to callable and to SQL."""

from __future__ import annotations

from marlstone.plans import aggregates, catalog, evaluation, evidence, governance, identities, joins, market, prices, scans, texts, windows

_MODULES = (prices, catalog, joins, aggregates, windows, texts, identities, evaluation, governance, market, scans, evidence)


def queries() -> dict:
    return {k: q for m in _MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, (_, sql) in m.QUERIES.items() if sql}

"""All queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from attestry.llm import consensus, credentials, cutoffs, encoding, mixing, quality, splits, syntax

MODULES = (consensus, credentials, syntax, splits, cutoffs, encoding, mixing, quality)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

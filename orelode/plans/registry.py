"""All queries over the test tables, by name, and their SQL."""

from __future__ import annotations

from orelode.plans import builds, evidence, graphs, packs, replies, rules, text

MODULES = (text, rules, graphs, builds, evidence, replies, packs)


def queries() -> dict:
    return {name: made for m in MODULES for name, (made, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

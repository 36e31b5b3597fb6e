"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from checks.modelled import EXACT, MODELLED


def queries():
    return {**{name: fn for name, (fn, _) in EXACT.items()}, **MODELLED}


def oracle_sql():
    return {name: sql for name, (_, sql) in EXACT.items()}

"""All registered queries of the experiment side, by name, and their SQL."""

from __future__ import annotations

from .queries import composite, design, dialogue, ledger, logs
from .queries.base import Query

PARTS = [ledger, dialogue, design, logs, composite]


def queries() -> dict[str, Query]:
    return {k: v for p in PARTS for k, v in p.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.R.sql.items()}

"""SQL that computes the named queries independently, for DuckDB."""

from __future__ import annotations

from glintmill.queries import PLANS


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in PLANS for name, text in plan.SQL.items()}

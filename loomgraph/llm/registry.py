"""What __spark_entry__.py registers from this subpackage."""

from __future__ import annotations

from loomgraph.llm import oracles, queries as q


def queries() -> dict:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

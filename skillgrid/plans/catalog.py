"""Registry of query plans and their DuckDB oracles.

``QUERIES`` maps a query name to a callable ``(spark, sf_dir) -> DataFrame``;
``ORACLES`` maps the same names to DuckDB SQL over the shared tables.  A name
without an oracle is checked on row counts only (documented per plan).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skillgrid.plans import (
    demand_plans, ops_plans, oracle_demand, oracle_ops, oracle_publish, oracle_records, oracle_stream, oracle_text,
    publish_plans, record_plans, stream_plans, text_plans,
)

Plan = Callable[[SparkSession, str], DataFrame]

_MODULES = (
    (text_plans, oracle_text),
    (demand_plans, oracle_demand),
    (publish_plans, oracle_publish),
    (ops_plans, oracle_ops),
    (record_plans, oracle_records),
    (stream_plans, oracle_stream),
)

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
for _plans, _oracle in _MODULES:
    for _name, _sql in _oracle.QUERIES.items():
        QUERIES[_name] = getattr(_plans, _name)
        ORACLES[_name] = _sql

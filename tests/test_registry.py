"""Every registered query runs on the smallest tables with a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["role_id", "skill_id", "skill_posting_count", "role_required_total", "frequency_share",
                          "recency_score", "growth_score", "demand_index"]
    assert df.count() > 0


def test_every_query_has_oracle_or_reason():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)

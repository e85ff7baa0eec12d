"""Registered queries against their SQL counterparts; tools/check_oracles.py runs all of them at a larger scale."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF
from tools.check_oracles import families, rows_of

SAMPLE = ["bounds", "quantile_bins", "window_monitor_by_user", "hopping_summary", "prefix_sketch",
          "repair_greedy_swap", "repair_naive", "repair_optimal_fair_blocks", "repair_stateful_delivery",
          "repair_stateful_reversed", "repair_captures_reversed", "strategy_compare_reversed", "stream_repair_closed",
          "ndcg_summary", "wilcoxon_exact", "grid_monitor"]


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["window_number", "fair_blocks", "is_fair"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("events", "orders"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries()[name](spark, SF)
    cursor = db.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert families(got.dtypes) == families(zip(names, [str(d[1]) for d in cursor.description], strict=True))
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())

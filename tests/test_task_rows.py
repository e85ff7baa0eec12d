"""A longer stream gets more tasks, not larger ones: ranks, tiles, running totals and sparse events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evenflow.operators import monitor, order, prep
from evenflow.operators.bounds import fit_bounds
from evenflow.operators.many_categories import fit_sparse_bounds, sparse_window_monitor
from evenflow.operators.order import ordered_stream


def most_rows(df):
    """(partitions, rows of the largest one)."""
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return len(sizes), max(sizes)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rows_of_a_task_are_bounded(spark, monkeypatch, keys):
    df = spark.range(6000).select("id", (F.col("id") % 2).alias("k"), F.substring(F.md5(F.col("id").cast("string")), 1, 1).alias("c"))
    bounds, sparse = fit_bounds(df, "c", 10), fit_sparse_bounds(df, "c", 10)
    queries = {
        "blocks": lambda s: monitor.sliding_blocks(s, "c", bounds),
        "running": lambda s: monitor.monitor_running(s, "c", bounds, 20),
        "sparse": lambda s: sparse_window_monitor(s, "c", sparse, 20),
    }
    short = ordered_stream(df, keys, ["id"])
    assert short.tasks is None  # left to Spark
    want = {name: sorted(map(tuple, q(short).collect()), key=str) for name, q in queries.items()}
    monkeypatch.setattr(order, "TASK_ROWS", 200)
    stream = ordered_stream(df, keys, ["id"], tile_rows=25)
    assert stream.tasks == 30
    for name, q in queries.items():
        result = q(stream)
        parts, rows = most_rows(result)
        assert parts == 30 and rows < 6000 / 5, name
        assert sorted(map(tuple, result.collect()), key=str) == want[name], name


def test_rows_of_a_task_are_bounded_in_seeded_runs(spark, monkeypatch):
    df = spark.range(6000).select("id", F.substring(F.md5(F.col("id").cast("string")), 1, 1).alias("c"))
    df = df.coalesce(2)
    want = sorted(map(tuple, prep.seeded_runs(df, 3, ["id"]).df.select("run_id", "id", "pos").collect()))
    repeated = []

    def seen(df, *args, **kwargs):
        repeated.append(df)
        return ordered_stream(df, *args, **kwargs)

    monkeypatch.setattr(order, "TASK_ROWS", 600)
    monkeypatch.setattr(prep, "ordered_stream", seen)
    runs = prep.seeded_runs(df, 3, ["id"])
    for rows in (repeated[0], runs.df):  # what is ranked, and what gets its positions
        parts, most = most_rows(rows)
        assert parts == 30 and most < 18000 / 5
    assert sorted(map(tuple, runs.df.select("run_id", "id", "pos").collect())) == want


def test_null_keys_keep_their_positions_in_many_tasks(spark, monkeypatch):
    df = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    monkeypatch.setattr(order, "TASK_ROWS", 50)
    stream = ordered_stream(df, ["k"], ["id"])
    assert stream.tasks == 12
    assert sorted((r.id, r.pos) for r in stream.df.collect()) == [(i, i // 3) for i in range(600)]

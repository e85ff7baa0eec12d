"""The monitor for very many categories: equal to the dense one, and nothing that grows with the categories."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evenflow.operators import many_categories as many
from evenflow.operators import monitor
from evenflow.operators.bounds import fit_bounds
from evenflow.operators.order import ordered_stream


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def sample(spark, kinds, rows=700, nulls=False):
    value = F.pmod(F.hash("id"), F.lit(kinds))
    if kinds > 4:  # one hot category beside the rare ones
        value = F.when(F.pmod(F.hash("id", F.lit(1)), F.lit(3)) == 0, F.lit(0)).otherwise(value)
    if nulls:
        value = F.when(F.col("id") % 11 != 0, value)
    return spark.range(rows).select("id", (F.col("id") % 3).alias("k"), value.alias("c"))


@pytest.mark.parametrize(("kinds", "keys", "mode"), [
    (3, ["k"], "two_sided"), (12, [], "two_sided"), (12, ["k"], "floor_only"), (12, [], "target")])
def test_equals_the_dense_monitor(spark, kinds, keys, mode):
    df = sample(spark, kinds, nulls=kinds == 12 and mode == "two_sided")
    stream = ordered_stream(df, keys, ["id"], tile_rows=64)
    dense = fit_bounds(df, "c", 10)
    dense = {"two_sided": dense, "floor_only": dense.floor_only(), "target": dense.target_as_floor()}[mode]
    sparse = many.fit_sparse_bounds(df, "c", 10, target=mode == "target")
    sparse = sparse.floor_only() if mode == "floor_only" else sparse
    assert len(sparse.listed) <= 20
    assert rows_of(many.sparse_window_monitor(stream, "c", sparse, 30)) == rows_of(monitor.window_monitor(stream, "c", dense, 30))
    blocks = many.sparse_sliding_blocks(stream, "c", sparse).select(*keys, "block_start", "is_fair")
    assert rows_of(blocks) == rows_of(monitor.sliding_blocks(stream, "c", dense).select(*keys, "block_start", "is_fair"))
    aligned = many.sparse_tumbling_blocks(stream, "c", sparse)
    assert rows_of(aligned.select(*keys, "block", "is_fair")) == rows_of(
        monitor.tumbling_blocks(stream, "c", dense).select(*keys, "block", "is_fair"))
    assert rows_of(aligned.select(*keys, "block", "deficit")) == rows_of(
        monitor.block_deficits(stream, "c", dense).select(*keys, "block", "deficit"))


def test_broken_bounds_are_counted(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aabcdeffgh")], "id long, c string")
    stream = ordered_stream(df, [], ["id"])
    bounds = many.SparseBounds(4, {"a": (1, 2)})
    got = {r.block_start: r.broken_bounds for r in many.sparse_sliding_blocks(stream, "c", bounds).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}


def test_ids_list_no_category(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7).alias("c"))
    bounds = many.fit_sparse_bounds(df, "c", 50)
    assert bounds.listed == {} and bounds.needed == 0
    stream = ordered_stream(df, [], ["id"], tile_rows=512)
    windows = many.sparse_window_monitor(stream, "c", bounds, 100)
    assert windows.count() == 4901 and windows.where("not is_fair").count() == 0
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("c#") < 200  # no column per category


def test_empty_and_all_null(spark):
    for df in (sample(spark, 3, rows=0), spark.range(30).select("id", F.lit(None).cast("long").alias("c"))):
        bounds = many.fit_sparse_bounds(df, "c", 10)
        stream = ordered_stream(df.select("id", "c"), [], ["id"])
        assert bounds.listed == {}
        assert many.sparse_window_monitor(stream, "c", bounds, 20).where("not is_fair").count() == 0
        assert many.sparse_tumbling_blocks(stream, "c", bounds).count() == df.count() // 10

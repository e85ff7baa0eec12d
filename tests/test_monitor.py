"""Order, bounds, sketches and monitoring against brute force and between the two ordering paths."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenflow.operators import monitor
from evenflow.operators.bounds import Bounds, bounds_table, category_counts, check_places, fit_bounds
from evenflow.operators.order import duplicate_order_keys, ordered_stream, running_totals
from evenflow.operators.sketch import backward_sketch, forward_sketch
from evenflow.sources.tables import union_all


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def word_stream(spark, text, **kw):
    df = spark.createDataFrame(list(enumerate(text)), "i long, c string")
    return ordered_stream(df, [], ["i"], **kw)


def brute_windows(labels, bounds, window):
    s, limits = bounds.block, list(zip(bounds.categories, bounds.floor, bounds.ceiling, strict=True))
    out = []
    for start in range(len(labels) - window + 1):
        blocks = [labels[b:b + s] for b in range(start, start + window, s)]
        fair = sum(all(lo <= block.count(c) <= hi for c, lo, hi in limits) for block in blocks)
        out.append((start + 1, fair, fair == len(blocks)))
    return out


@pytest.fixture(scope="module")
def skewed(events):
    """One key holds more than a third of all rows."""
    return events.select(F.when(F.col("user_id") < 6, F.lit("hot")).otherwise(F.col("user_id").cast("string"))
                         .alias("k"), "ts", "event_id", "event_type")


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_small_tiles_equal_one_stretch(skewed, keys):
    small = ordered_stream(skewed, keys, ["ts", "event_id"], how="window" if keys else "range")
    large = ordered_stream(skewed, keys, ["ts", "event_id"], how="range", tile_rows=16)
    assert rows(small.df) == rows(large.df)
    bounds = fit_bounds(skewed, "event_type", 5)
    for operator in (
        lambda s: forward_sketch(s, "event_type", bounds), lambda s: backward_sketch(s, "event_type", bounds),
        lambda s: monitor.window_monitor(s, "event_type", bounds, 40),
        lambda s: monitor.sliding_blocks(s, "event_type", bounds),
        lambda s: monitor.tumbling_blocks(s, "event_type", bounds),
        lambda s: monitor.monitor_running(s, "event_type", bounds, 20),
        lambda s: monitor.hopping_summary(s, "event_type", bounds, 20, 3),
        lambda s: monitor.remaining_deficit(s, "event_type", bounds),
        lambda s: monitor.monitor_summary(s, "event_type", bounds, 20),
    ):
        assert rows(operator(small)) == rows(operator(large))


def test_order_has_one_path_unless_the_caller_vouches_for_small_keys(skewed):
    assert ordered_stream(skewed, ["k"], ["event_id"]).tile_rows
    assert ordered_stream(skewed, ["k"], ["event_id"], how="window").tile_rows is None
    with pytest.raises(ValueError):
        ordered_stream(skewed, [], ["event_id"], how="window")


def test_monitor_matches_brute_force(events):
    bounds = fit_bounds(events, "event_type", 10)
    labels = [r.event_type for r in events.orderBy("ts", "event_id").collect()]
    stream = ordered_stream(events, [], ["ts", "event_id"], how="range", tile_rows=64)
    for b in (bounds, bounds.floor_only(), bounds.target_as_floor()):
        assert rows(monitor.window_monitor(stream, "event_type", b, 30)) == brute_windows(labels, b, 30)


def test_golden_monitor(spark):
    bounds = Bounds.from_limits({"A": 1, "B": 1}, 2, {"A": 1, "B": 1})
    stream = word_stream(spark, "ABABBBAA")
    seen = monitor.window_monitor(stream, "c", bounds, 4).orderBy("window_number").collect()
    assert [r.fair_blocks for r in seen] == [2, 1, 1, 1, 0]
    total = monitor.monitor_summary(stream, "c", bounds, 4).first()
    assert (total.windows, total.total_blocks, total.fair_blocks, total.fair_windows) == (5, 10, 5, 1)
    assert monitor.monitor_summary(stream, "c", bounds, 4, max_windows=2).first().fair_blocks == 3


def test_window_shapes(spark):
    bounds = Bounds.from_limits({"A": 1, "B": 1}, 2, {"A": 1, "B": 1})
    assert rows(monitor.window_monitor(word_stream(spark, "AB"), "c", bounds, 4)) == []
    assert rows(monitor.window_monitor(word_stream(spark, "ABB"), "c", bounds, 2)) == [(1, 1, True), (2, 0, False)]
    with pytest.raises(ValueError):
        monitor.window_monitor(word_stream(spark, "ABAB"), "c", bounds, 3)


def test_empty_category_and_nulls(spark):
    bounds = Bounds.from_limits({"A": 1, "B": 0, "Z": 0}, 2, {"A": 2, "B": 1, "Z": 0})
    df = spark.createDataFrame([(0, "A"), (1, None), (2, "A"), (3, "B")], "i long, c string")
    stream = ordered_stream(df, [], ["i"])
    blocks = monitor.tumbling_blocks(stream, "c", bounds).orderBy("block").collect()
    assert [(r.c0, r.c1, r.c2, r.is_fair) for r in blocks] == [(1, 0, 0, True), (1, 1, 0, True)]
    assert category_counts(df, "c") == {"A": 2, "B": 1}


def test_unknown_category_raises_where_labels_are_needed(spark):
    bounds = Bounds.from_limits({"A": 1, "B": 1}, 2)
    df = spark.createDataFrame([("A",), ("C",)], "c string")
    with pytest.raises(PySparkException, match="category not in the bounds"):
        df.select(bounds.label_index("c")).collect()
    assert df.where(bounds.known("c")).count() == 1


def test_bounds_table_equals_fitted_bounds(events):
    table = {r.category: r for r in bounds_table(events, "event_type", 17).collect()}
    bounds = fit_bounds(events, "event_type", 17)
    for name, low, high, target in zip(bounds.categories, bounds.floor, bounds.ceiling, bounds.target, strict=True):
        assert (table[name].floor, table[name].ceiling, table[name].reorder_target) == (low, high, target)
    assert sum(bounds.target) == 17
    with pytest.raises(ValueError):
        check_places(fit_bounds(events, "event_type", 4))
    with pytest.raises(ValueError):
        category_counts(events, "event_id", places=20)


def test_numeric_categories_keep_natural_order(spark):
    df = spark.createDataFrame([(i,) for i in [10, 9, 2, 10]], "c int")
    assert list(category_counts(df, "c")) == ["2", "9", "10"]


def test_backward_equals_tumbling_in_floor_mode(skewed):
    bounds = fit_bounds(skewed, "event_type", 5)
    for how in ("window", "range"):
        stream = ordered_stream(skewed, ["k"], ["ts", "event_id"], how=how, tile_rows=16)
        floor = monitor.tumbling_blocks(stream, "event_type", bounds.floor_only())
        assert rows(monitor.backward_blocks(stream, "event_type", bounds)) == rows(floor, "k", "block", "is_fair")


def test_hopping_summary_counts_distinct_blocks(spark):
    bounds = Bounds.from_limits({"A": 1, "B": 1}, 2)
    text = "ABBBABAABBAB"
    got = monitor.hopping_summary(word_stream(spark, text), "c", bounds, 4, 2).first()
    starts = range(0, len(text) - 3, 2)
    blocks = {s + j for s in starts for j in (0, 2)}
    fair = {b for b in blocks if {"A", "B"} <= set(text[b:b + 2])}
    assert (got.windows, got.distinct_blocks, got.fair_distinct_blocks) == (len(starts), len(blocks), len(fair))
    assert got.fair_windows == sum({s, s + 2} <= fair for s in starts)


def test_first_unfair_block(spark):
    bounds = Bounds.from_limits({"A": 1, "B": 1}, 2)
    assert monitor.first_unfair_block(word_stream(spark, "ABABBB"), "c", bounds).first()[0] == 4
    assert monitor.first_unfair_block(word_stream(spark, "ABAB"), "c", bounds).first()[0] is None


def test_monitor_summaries_equal_single_summaries(skewed):
    bounds = fit_bounds(skewed, "event_type", 5)
    stream = ordered_stream(skewed, ["k"], ["ts", "event_id"], how="range", tile_rows=16)
    cases = {"a": (bounds, 20), "b": (bounds.floor_only(), 20), "c": (bounds, 60)}
    single = union_all([
        monitor.monitor_summary(stream, "event_type", b, w, 30).withColumn("case", F.lit(n)) for n, (b, w) in cases.items()
    ])
    shared = monitor.monitor_summaries(stream, "event_type", cases, 30)
    assert rows(shared, *sorted(shared.columns)) == rows(single, *sorted(shared.columns))
    with pytest.raises(ValueError):
        monitor.monitor_summaries(stream, "event_type", {"a": (bounds, 20), "b": (fit_bounds(skewed, "event_type", 6), 12)})


def test_running_totals_exclusive(spark):
    df = spark.createDataFrame([(0, i, 1) for i in range(50)], "k int, i long, v int")
    for keys, how in ((["k"], "window"), (["k"], "range"), ([], "range")):
        stream = ordered_stream(df, keys, ["i"], how=how, tile_rows=7)
        before = running_totals(stream, {"t": F.col("v")}, inclusive=False)
        assert rows(before, "pos", "t") == [(i, i) for i in range(50)]


def test_duplicate_order_keys_are_reported(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 5)], "k int, t int")
    assert rows(duplicate_order_keys(df, ["k"], ["t"])) == [(1, 5, 2)]


def test_window_updates(spark):
    bounds = Bounds.from_limits({"A": 1, "B": 1}, 2, {"A": 1, "B": 1})
    seen = monitor.window_updates(word_stream(spark, "ABABB"), "c", bounds, 4, max_windows=1).collect()
    assert len(seen) == 1 and seen[0].window_items == list("ABAB") and seen[0].metrics.fair_block_pct == 100.0


def test_latency_report(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)], "ms double")
    report = monitor.latency_report(df, [], "ms", 21).first()
    assert report.calls == 11 and report.p90_ms == pytest.approx(10.0)
    assert report.windows_per_second == pytest.approx(21 * 1000 / 6.0)

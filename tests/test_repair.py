"""Chunk repair and stateful windowed repair."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenflow.operators import repair
from evenflow.operators.bounds import Bounds, fit_bounds
from evenflow.operators.order import ordered_stream
from evenflow.operators.stateful import compare_strategies, stateful_repair, strategy_metrics
from evenflow.plans.episode import Episode
from evenflow.plans.registry import Strategy, register_strategy, strategy, template_function

ALL = ["before", "optimal", "naive", "naive_reversed", "internal_swap", "greedy_swap", "weighted_greedy_swap"]
PAIR = Bounds.from_limits({"A": 1, "B": 1}, 2, {"A": 1, "B": 1})


def stream_of(spark, text):
    return ordered_stream(spark.createDataFrame(list(enumerate(text)), "i long, c string"), [], ["i"])


def text_of(df, order):
    return "".join(r.category for r in df.orderBy(*order).collect())


def test_golden_chunks(spark):
    bounds = Bounds.from_limits({"A": 2, "B": 1, "C": 2}, 5, {"A": 2, "B": 1, "C": 2})
    chunks = repair.cut_chunks(stream_of(spark, "AAAAABBBBBBCCCCCCCCC"), "c", bounds, 10, 10)
    done = repair.repair_chunks(chunks, ["naive", "naive_reversed"])
    assert text_of(done.where("strategy = 'naive'"), ["position_in_chunk"]) == "BCCAABCCAABCCABBCCBC"
    assert text_of(done.where("strategy = 'naive_reversed'"), ["position_in_chunk"]) == "CCCBBBBACCABACCABACC"


@pytest.fixture(scope="module")
def chunks(events):
    bounds = fit_bounds(events, "event_type", 10)
    stream = ordered_stream(events, [], ["ts", "event_id"])
    return repair.cut_chunks(stream, "event_type", bounds, 20, 10, ["event_id", "value", "user_id"])


def test_repair_permutes_whole_rows_in_fifo_order(chunks, events):
    done = repair.repair_chunks(chunks, ALL)
    original = events.select("event_id", "event_type", "value", "user_id")
    for (name,) in done.select("strategy").distinct().collect():
        part = done.where(F.col("strategy") == name)
        assert part.select("event_id", F.col("category").alias("event_type"), "value", "user_id").exceptAll(
            original).count() == 0
        pdf = part.toPandas().sort_values(["chunk", "position_in_chunk"])
        assert (pdf.groupby("chunk").position_in_chunk.apply(list).map(lambda p: p == list(range(len(p))))).all()
        assert len(pdf) == events.count() and pdf.chunk.nunique() == 34  # the last one is short
        assert pdf.groupby(["chunk", "category"]).source_position.apply(lambda p: p.is_monotonic_increasing).all()
    assert done.where("strategy = 'before' AND position_in_chunk <> source_position").count() == 0


def test_both_ways_of_scoring_agree(chunks):
    labelled = chunks.df.select("chunk", repair.chunk_labels().alias("labels"))
    args = ("labels", ALL, chunks.bounds, 20, 10)
    in_place = repair.plan_scores(labelled, *args)
    by_rows = repair.score_templates(repair.plan_templates(labelled, *args), ["chunk"], "labels", chunks.bounds, 20)
    columns = ["chunk", "strategy", "windows", "fair_blocks", "fair_windows", "changed"]
    assert sorted(map(tuple, in_place.where("windows > 0").select(columns).collect())) == sorted(map(tuple, by_rows.select(columns).collect()))


def test_potential_is_reached(chunks):
    potential = {r.chunk: r for r in repair.chunk_potential(chunks).collect()}
    pdf = repair.repair_chunks(chunks, ["optimal"]).toPandas().sort_values(["chunk", "position_in_chunk"])
    b = chunks.bounds
    for chunk, labels in pdf.groupby("chunk").category.apply(list).items():
        fair = sum(
            all(lo <= labels[i:i + 10].count(c) <= hi for c, lo, hi in zip(b.categories, b.floor, b.ceiling, strict=True))
            for i in range(len(labels) - 9)
        )
        assert fair == potential[chunk].attainable_blocks
        counts = [labels.count(c) for c in b.categories]
        assert potential[chunk].counts == counts
        assert potential[chunk].pattern_copies == min(n // t for n, t in zip(counts, b.target, strict=True) if t)
        assert potential[chunk].tileable == all(len(labels) // 10 * lo <= n <= len(labels) // 10 * hi for n, lo, hi in
                                                zip(counts, b.floor, b.ceiling, strict=True))


def test_uneven_landmark_only_for_the_optimal_strategy(events):
    bounds = fit_bounds(events, "event_type", 10)
    stream = ordered_stream(events, [], ["ts", "event_id"])
    uneven = repair.cut_chunks(stream, "event_type", bounds, 20, 7, ["event_id"])
    done = repair.repair_chunks(uneven, ["optimal"])
    assert done.count() == events.count() and done.select("event_id").distinct().count() == events.count()
    with pytest.raises(ValueError):
        repair.repair_chunks(uneven, ["naive"])
    with pytest.raises(ValueError):
        stateful_repair(stream, "event_type", bounds, 20, 7, primary="naive")
    with pytest.raises(ValueError):
        repair.repair_chunks(uneven, ["no such strategy"])


def test_user_strategy(chunks):
    register_strategy(Strategy("sorted", False, lambda bounds, window: np.sort, needs_whole_blocks=False))
    done = repair.repair_chunks(chunks, ["sorted"]).toPandas().sort_values(["chunk", "position_in_chunk"])
    assert done.groupby("chunk").category.apply(lambda c: c.is_monotonic_increasing).all()


def test_golden_stateful_repair(spark):
    trace = stateful_repair(stream_of(spark, "ABAABBAB"), "c", PAIR, 4, 2)
    assert text_of(trace.delivered(), ["out_pos"]) == "ABABABAB"
    chunk = trace.captures().where("phase = 'reordered'")
    assert text_of(chunk, ["position_in_chunk"]) == "ABABAB"
    assert [r.pos for r in chunk.orderBy("position_in_chunk").collect()] == [0, 1, 2, 4, 3, 5]
    metrics = {r.strategy: r for r in strategy_metrics(trace, ["optimal"], by=[]).collect()}
    before, after = metrics["before"], metrics["optimal"]
    assert (before.compat_total_blocks, before.compat_fair_blocks) == (12, 7)
    assert before.compat_pct_fair == pytest.approx(58.3333333)
    assert (before.compat_windows, before.compat_fair_windows) == (5, 3)
    assert (after.compat_fair_blocks, after.compat_pct_fair, after.total_swaps) == (6, 50.0, 2)
    assert trace.summaries().first().windows_covered == 5


def step_by_step(labels, bounds, window, landmark, max_windows=None):
    """The windowed repair one row at a time, straight from its definition."""
    reorder = template_function(strategy("optimal"), bounds, window)
    floor, ceiling, s = bounds.floor, bounds.ceiling, bounds.block
    buffer, out, windows, edits, fair_checks = [], [], 0, 0, 0
    arrivals = iter(range(len(labels)))
    for row in arrivals:
        buffer.append(row)
        if len(buffer) > window:
            out.append(buffer.pop(0))
        if len(buffer) < window:
            continue
        now = [labels[r] for r in buffer]
        fair = all(lo <= now[b:b + s].count(c) <= hi for b in range(0, window, s)
                   for c, (lo, hi) in enumerate(zip(floor, ceiling, strict=True)))
        if fair:
            windows += 1
            fair_checks += 1
        elif row + landmark < len(labels):
            chunk = buffer + [next(arrivals) for _ in range(landmark)]
            word = np.array([labels[r] for r in chunk])
            queues = {c: [r for r in chunk if labels[r] == c] for c in set(word.tolist())}
            chunk = [queues[c].pop(0) for c in reorder(word).tolist()]
            out += chunk[:landmark]
            buffer = chunk[landmark:]
            windows += 1 + landmark
            edits += 1
        else:
            break
        if max_windows is not None and windows >= max_windows:
            return out + buffer, edits, fair_checks, windows
    seen = set(out) | set(buffer)
    return out + buffer + [r for r in range(len(labels)) if r not in seen], edits, fair_checks, windows


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.sampled_from([(4, 2, 2), (6, 3, 6), (6, 2, 0), (4, 4, 3), (8, 4, 1)]),
       st.integers(1, 11), st.sampled_from([None, 5, 17]))
def test_episode_equals_step_by_step(labels, sizes, piece, max_windows):
    window, block, landmark = sizes
    bounds = Bounds.from_counts({"A": 3, "B": 2, "C": 1}, block)
    run = Episode(window, landmark, block, np.array(bounds.floor), np.array(bounds.ceiling),
                  template_function(strategy("optimal"), bounds, window), max_windows)
    out = []
    for start in range(0, len(labels), piece):
        part = np.array(labels[start:start + piece])
        run.feed(np.arange(start, start + len(part)), part)
        out += run.take().tolist()
    out += run.finish().tolist()
    want, edits, fair_checks, windows = step_by_step(labels, bounds, window, landmark, max_windows)
    assert (run.edits, run.fair_checks, run.windows) == (edits, fair_checks, windows)
    if max_windows is None:
        assert out == want
    else:
        assert out[:len(want)] == want


def test_keys_span_arrow_batches(spark, events):
    keyed = events.withColumn("k", F.when(F.col("user_id") < 8, None).otherwise(F.col("user_id") % 2))
    bounds = fit_bounds(events, "event_type", 5)
    stream = ordered_stream(keyed, ["k"], ["ts", "event_id"])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    results = []
    for batch in (size, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        trace = stateful_repair(stream, "event_type", bounds, 20, 10, restart_every=200)
        results.append(sorted(map(tuple, trace.delivered(["event_id"]).select("event_id", "episode", "out_pos").collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert results[0] == results[1] and len(results[0]) == events.count()


def test_short_streams_and_cut_landmarks(spark):
    assert text_of(stateful_repair(stream_of(spark, "AAB"), "c", PAIR, 4, 2).delivered(), ["out_pos"]) == "AAB"
    cut = stateful_repair(stream_of(spark, "AAABB"), "c", PAIR, 4, 2)
    assert text_of(cut.delivered(), ["out_pos"]) == "AAABB" and cut.summaries().first().edits == 0
    empty = stateful_repair(stream_of(spark, "AABB"), "c", PAIR, 4, 0)
    assert text_of(empty.delivered(), ["out_pos"]) == "ABAB"
    with pytest.raises(ValueError):
        stateful_repair(stream_of(spark, "AABB"), "c", PAIR, 4, 2, restart_every=5)


def test_log_without_edits_is_one_entry_per_row(events):
    bounds = fit_bounds(events, "event_type", 5)
    stream = ordered_stream(events, [], ["ts", "event_id"])
    trace = stateful_repair(stream, "event_type", bounds, 20, 10, log_edits=False)
    assert trace.chunks().count() == 0
    assert trace.df.agg(F.sum(F.when(F.col("kind") == "delivered", F.size("rows")))).first()[0] == events.count()


def test_comparison_uses_identical_chunks(events):
    bounds = fit_bounds(events, "event_type", 5)
    trace = stateful_repair(ordered_stream(events, [], ["ts", "event_id"]), "event_type", bounds, 20, 10).materialized()
    plans = compare_strategies(trace, ["optimal", "naive"])
    assert plans.groupBy("episode", "edit_event").agg(F.countDistinct("labels").alias("n")).where("n > 1").count() == 0
    per_run = strategy_metrics(trace, ["optimal", "naive"])
    assert {r.strategy for r in per_run.collect()} == {"before", "optimal", "naive"}
    assert all(r.pct_fair >= b.pct_fair for r in per_run.where("strategy = 'optimal'").collect()
               for b in per_run.where("strategy = 'before'").collect() if r.episode == b.episode)

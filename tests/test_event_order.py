"""Event-time order: shuffled arrival gives the batch order, late rows come out marked and counted."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evenflow.operators.bounds import fit_bounds
from evenflow.operators.monitor import window_monitor
from evenflow.operators.order import ordered_stream
from evenflow.operators.stateful import stateful_repair
from evenflow.sources.streams import append_sink, read_files
from evenflow.streaming.event_order import list_states, order_events
from evenflow.streaming.stateful import stream_monitor, stream_repair

SCHEMA = "k string, ts timestamp, id long, c string, ends boolean"


def replay(spark, folder, files):
    """One file a micro-batch, in order."""
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return read_files(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def drained(spark, df, tmp_path, name):
    run = append_sink(df, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}-out")


def arrivals(seed, n=400, jitter=30, batches=6):
    """Rows with a second between them that arrive up to ``jitter`` seconds late, some much later."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        late = rng.random() * (jitter if rng.random() < 0.93 else 8 * jitter)
        rows.append((i + late, f"k{rng.randrange(3)}", i // 2, i, rng.choice("aab")))
    rows.sort()
    cut = len(rows) // batches + 1
    return [rows[i:i + cut] for i in range(0, len(rows), cut)]


def expected(files, delay):
    newest, on_time, late = {}, {}, {}
    for rows in files:
        mark = {k: v - delay for k, v in newest.items()}
        for _, k, ts, i, c in rows:
            if k in mark and ts < mark[k]:
                late.setdefault(k, []).append(i)
            else:
                on_time.setdefault(k, []).append((ts, i, c))
                newest[k] = max(newest.get(k, ts), ts)
    return {k: sorted(v) for k, v in on_time.items()}, {k: sorted(v) for k, v in late.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_order_late_rows_and_what_follows(spark, tmp_path, seed):
    delay, files = 20, arrivals(seed)
    last = {k: n for n, rows in enumerate(files) for _, k, *_ in rows}
    written, closed = [], set()
    for n, rows in enumerate(files):
        part = []
        for _, k, ts, i, c in rows:
            ends = last[k] == n and k not in closed
            closed |= {k} if ends else set()
            part.append((k, datetime.fromtimestamp(1_700_000_000 + ts), i, c, ends))
        written.append(part)
    live = replay(spark, f"{tmp_path}/in", written)
    with list_states(spark):
        got = drained(spark, order_events(live, ["k"], "ts", ["id"], delay * 1000, closes="ends"), tmp_path, "order")
    on_time, late = expected(files, delay)
    rows = got.collect()
    assert len(rows) == sum(map(len, files)) and any(late.values())
    for k, want in on_time.items():
        assert [r.id for r in sorted((r for r in rows if r.k == k and not r.late), key=lambda r: r.place)] == [i for _, i, _ in want]
    for k in on_time:
        own = [r for r in rows if r.k == k and r.late]
        assert sorted(r.id for r in own) == late.get(k, []) and sorted(r.place for r in own) == list(range(1, len(own) + 1))

    # What the ordered stream feeds: monitor and repair equal the batch run over the rows on time.
    ordered = got.where("NOT late").select("k", "place", "id", F.get_json_object("value", "$.c").alias("c"))
    bounds = fit_bounds(ordered, "c", 5)
    feed = read_files(spark, f"{tmp_path}/order-out", got.schema, 100).where("NOT late").select(
        "k", "place", "id", F.get_json_object("value", "$.c").alias("c"))
    stream = ordered_stream(ordered, ["k"], ["place"])
    seen = drained(spark, stream_monitor(feed, ["k"], ["place"], "c", bounds, 10), tmp_path, "monitor")
    want = window_monitor(stream, "c", bounds, 10)
    cols = ["k", "window_number", "fair_blocks", "is_fair"]
    assert sorted(map(tuple, seen.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    fixed = drained(spark, stream_repair(feed, ["k"], ["place"], "c", bounds, 10, 5), tmp_path, "repair")
    delivered = {(r.k, r.out_pos): r.category for r in fixed.collect()}
    batch = {(r.k, r.out_pos): r.category for r in stateful_repair(stream, "c", bounds, 10, 5).delivered().collect()}
    assert delivered and all(batch[p] == c for p, c in delivered.items())


def test_rows_wait_for_the_watermark(spark, tmp_path):
    at = datetime.fromtimestamp
    live = replay(spark, f"{tmp_path}/in", [[("a", at(1_000_010), 1, "x", False), ("a", at(1_000_005), 2, "x", None)], [("a", at(1_000_012), 3, "x", False)],
                                            [("a", None, 4, "x", False), ("a", at(1_000_001), 5, "x", False), ("b", None, 6, "x", False)]])
    with list_states(spark):
        got = drained(spark, order_events(live, ["k"], "ts", ["id"], 6000), tmp_path, "order").collect()
    assert sorted((r.k, r.late, r.place, r.id) for r in got) == [("a", False, 0, 2), ("a", True, 1, 4), ("a", True, 2, 5)]

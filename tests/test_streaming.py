"""Streaming equals batch, whatever the micro-batches look like."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evenflow.operators.bounds import Bounds, fit_bounds
from evenflow.operators.monitor import monitor_running
from evenflow.operators.order import ordered_stream
from evenflow.operators.stateful import stateful_repair
from evenflow.sources.streams import append_sink, commit_sink, decode_messages, encode_messages, read_committed, read_files
from evenflow.streaming.arrivals import arrival_gaps, arrival_summary
from evenflow.streaming.stateful import stream_monitor, stream_repair


@pytest.fixture(scope="module")
def keyed(events):
    return events.select((F.col("user_id") % 3).alias("k"), "ts", "event_id", "event_type")


def write_in_order(df, folder, files):
    """Files of consecutive rows; Spark reads them one per trigger, oldest first."""
    rows = df.orderBy("ts", "event_id").toPandas()
    step = -(-len(rows) // files)
    spark = df.sparkSession
    for i in range(files):
        part = rows.iloc[i * step:(i + 1) * step].sample(frac=1, random_state=i)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)


def run_to_rows(spark, query_df, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    query = append_sink(query_df, out, str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(query_df.schema).parquet(out)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_monitor_equals_batch(spark, keyed, tmp_path, files):
    folder = str(tmp_path / "in")
    write_in_order(keyed, folder, files)
    bounds = fit_bounds(keyed, "event_type", 5)
    live = stream_monitor(read_files(spark, folder, keyed.schema), ["k"], ["ts", "event_id"], "event_type", bounds,
                          20, with_items=True)
    got = run_to_rows(spark, live, tmp_path, "monitor")
    want = monitor_running(ordered_stream(keyed, ["k"], ["ts", "event_id"]), "event_type", bounds, 20)
    cols = ["k", "window_number", "fair_blocks", "is_fair", "fair_so_far"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.where(F.size("window_items") != 20).count() == 0


@pytest.mark.parametrize("files", [1, 5])
def test_stream_repair_equals_batch(spark, keyed, tmp_path, files):
    folder = str(tmp_path / "in")
    write_in_order(keyed, folder, files)
    bounds = fit_bounds(keyed, "event_type", 5)
    live = stream_repair(read_files(spark, folder, keyed.schema), ["k"], ["ts", "event_id"], "event_type", bounds,
                         20, 10)
    got = run_to_rows(spark, live, tmp_path, "repair")
    stream = ordered_stream(keyed, ["k"], ["ts", "event_id"])
    want = stateful_repair(stream, "event_type", bounds, 20, 10).delivered()
    lengths = {r.k: r["count"] for r in keyed.groupBy("k").count().collect()}
    delivered = {(r.k, r.out_pos): (r.arrival, r.category) for r in got.collect()}
    expected = {(r.k, r.out_pos): (r.pos, r.category) for r in want.collect()}
    assert delivered and all(expected[key] == value for key, value in delivered.items())
    for k, n in lengths.items():
        open_rows = n - sum(key[0] == k for key in delivered)
        assert 0 < open_rows < 20 + 10 + 1
    parsed = got.select(F.from_json("value", keyed.schema).alias("r"), "category").where("r.event_type <> category")
    assert parsed.count() == 0


def test_stream_repair_stops_after_max_windows(spark, keyed, tmp_path):
    folder = str(tmp_path / "in")
    write_in_order(keyed, folder, 3)
    bounds = fit_bounds(keyed, "event_type", 5)
    live = stream_repair(read_files(spark, folder, keyed.schema), ["k"], ["ts", "event_id"], "event_type", bounds,
                         20, 10, max_windows=40)
    got = run_to_rows(spark, live, tmp_path, "stopped")
    stream = ordered_stream(keyed, ["k"], ["ts", "event_id"])
    trace = stateful_repair(stream, "event_type", bounds, 20, 10, max_windows=40)
    covered = {r.k: r.windows_covered for r in trace.summaries().collect()}
    assert all(40 <= w <= 51 for w in covered.values())
    per_key = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert set(per_key) == set(covered)


def test_messages_round_trip(spark, events):
    rows = events.select("event_id", "event_type", "value")
    sent = encode_messages(rows)
    assert {r.key for r in sent.select("key").distinct().collect()} == {"stream"}
    raw = sent.select(F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit(0).alias("partition"),
                      F.lit(0).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))
    back = decode_messages(raw, rows.schema).select("event_id", "event_type", "value")
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()


def test_arrival_gaps(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2024-01-01 "
                     "00:00:01.5'), (3, timestamp_ntz'2024-01-01 00:00:02') AS t(i, ts)")
    gaps = arrival_gaps(ordered_stream(rows, [], ["i"], how="range", tile_rows=2), "ts")
    assert [tuple(r) for r in gaps.orderBy("item_number").collect()] == [
        (1, 0.0, 0.0), (2, 1500.0, 1500.0), (3, 2000.0, 500.0)]
    assert arrival_summary(gaps).first()["items"] == 3


def test_golden_repair_in_one_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate("ABAABBAB")], "k string, i long, c string")
    folder = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(folder)
    bounds = Bounds.from_limits({"A": 1, "B": 1}, 2, {"A": 1, "B": 1})
    live = stream_repair(read_files(spark, folder, rows.schema), ["k"], ["i"], "c", bounds, 4, 2)
    got = run_to_rows(spark, live, tmp_path, "golden").orderBy("out_pos").collect()
    assert [r.arrival for r in got] == [0, 1, 2, 4]


def test_commit_sink_holds_a_repeated_batch_once(spark, keyed, tmp_path):
    """The query fails after a batch was written and before Spark noted it; the restart gets the same batch again."""
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_in_order(keyed, folder, 3)
    seen = []

    def fail_once(number):
        seen.append(number)
        if seen == [0, 1]:
            raise RuntimeError("driver lost")

    def start():
        live = read_files(spark, folder, keyed.schema)
        return commit_sink(live, out, state, "rows", after=fail_once).trigger(availableNow=True).start()

    assert read_committed(spark, out, keyed.schema).count() == 0
    with pytest.raises(Exception, match="driver lost"):
        start().awaitTermination(300)
    before = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    half = Path(out) / "query=rows" / "batch=2"
    half.mkdir()
    shutil.copy(next(iter(before)), half / "part-of-a-lost-task.parquet")   # no success marker: must not be read, is replaced
    assert read_committed(spark, out, keyed.schema).select("batch").distinct().count() == 2
    start().awaitTermination(300)
    assert seen == [0, 1, 1, 2]
    assert all(p.stat().st_mtime_ns == at for p, at in before.items())
    got = read_committed(spark, out, keyed.schema)
    assert got.count() == keyed.count() and got.select("event_id").distinct().count() == keyed.count()

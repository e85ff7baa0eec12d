"""Keys that share a group keep their own watermark, places and null-ness, and cost the state no entry each."""

from __future__ import annotations

from datetime import datetime, timedelta

from evenflow.sources.streams import append_sink, read_files
from evenflow.streaming.event_order import list_states, order_events

SCHEMA = "k long, ts timestamp, id long, ends boolean"
BIG = (1 << 60) + 1


def test_many_keys_in_few_groups(spark, tmp_path):
    start, keys = datetime(2024, 1, 1), [None, BIG, BIG + 1, 0, *range(1, 60)]
    files = [[], [], []]
    for n, k in enumerate(keys):
        for i, (file, second) in enumerate([(0, 10), (0, 5), (1, 30), (1, 1), (2, 29), (2, 40)]):  # 1 is late in file 1
            files[file].append((k, start + timedelta(seconds=second + n), 10 * n + i, file == 2 and i == 5 and n % 2 == 0))
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    with list_states(spark):
        ordered = order_events(live, ["k"], "ts", ["id"], 2000, closes="ends", groups=2)
        run = append_sink(ordered, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert state and max(state) <= 8
    got = spark.read.schema(ordered.schema).parquet(f"{tmp_path}/out").collect()
    want = []
    for n, k in enumerate(keys):
        base = 10 * n
        on_time = [base + 1, base, base + 4, base + 2, base + 5]
        # Without an end, the newest rows (29, 30 and 40 seconds; the watermark is at 38) leave only up to the watermark.
        want += [(k, i, place, False) for place, i in enumerate(on_time if n % 2 == 0 else on_time[:-1])]
        want.append((k, base + 3, 1, True))
    assert sorted(((r.k, r.id, r.place, r.late) for r in got), key=str) == sorted(want, key=str)


def test_idle_keys_leave_one_by_one(spark, tmp_path):
    at = datetime.fromtimestamp
    spark.createDataFrame([(k, at(1_000_000 + k), k, False) for k in (1, 2, None, 4) if k] + [(None, at(1_000_000), 9, False)], SCHEMA).coalesce(
        1).write.parquet(f"{tmp_path}/in")
    live = read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    with list_states(spark):
        ordered = order_events(live, ["k"], "ts", ["id"], 60_000, idle_ms=500, groups=1)
        run = append_sink(ordered, f"{tmp_path}/out", f"{tmp_path}/state").trigger(processingTime="1 second").start()
        try:
            for _ in range(40):
                run.awaitTermination(1)
                if (tmp_path / "out" / "_spark_metadata").exists() and spark.read.schema(ordered.schema).parquet(f"{tmp_path}/out").count() == 4:
                    break
        finally:
            run.stop()
    got = spark.read.schema(ordered.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(((r.k, r.id, r.place, r.late) for r in got), key=str) == sorted([(1, 1, 0, False), (2, 2, 0, False), (4, 4, 0, False), (None, 9, 0, False)], key=str)

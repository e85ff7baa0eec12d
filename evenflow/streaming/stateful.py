"""Structured Streaming: count-based window monitor and windowed repair with keyed state.

State per key is one window (plus landmark) of rows. A micro-batch does not keep arrival order, so rows are
sorted by ``order_by`` inside it; order across micro-batches is arrival order. A key is handled by one task per
micro-batch: publish a very hot stream under several keys, or repair it with stateless chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from evenflow.operators.bounds import Bounds
from evenflow.operators.monitor import check_window
from evenflow.plans.episode import Episode
from evenflow.plans.labels import fair_blocks_per_window
from evenflow.plans.registry import strategy, template_function


def stream_monitor(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], attr: str, bounds: Bounds,
                   window: int, max_windows: int | None = None, with_items: bool = False) -> DataFrame:
    """One record per full window and key: number, fair blocks, verdict, running share; items on request."""
    blocks = check_window(window, bounds.block)
    narrow = df.select(*keys, *order_by, bounds.label_index(attr).alias("_g"))
    out = narrow.select(*keys).schema.fields + StructType.fromDDL(
        "window_number bigint, fair_blocks int, is_fair boolean, fair_so_far bigint, pct_so_far double"
        + (", window_items array<string>" if with_items else "")
    ).fields
    state = StructType.fromDDL("labels array<int>, windows bigint, fair bigint")
    floor, ceiling, names = np.array(bounds.floor), np.array(bounds.ceiling), np.array(bounds.categories)

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        kept, windows, fair = group.get if group.exists else ([], 0, 0)
        fresh = _in_order(batches, order_by)
        labels = np.concatenate([np.array(kept, dtype=np.int64), fresh["_g"].to_numpy(dtype=np.int64)])
        count = len(labels) - window + 1
        if count > 0 and max_windows is not None:
            count = max(0, min(count, max_windows - windows))
        if count > 0:
            good = fair_blocks_per_window(labels, window, bounds.block, floor, ceiling)[:count]
            numbers, so_far = windows + 1 + np.arange(count), fair + np.cumsum(good)
            record = {name: [value] * count for name, value in zip(keys, key, strict=True)} | {
                "window_number": numbers, "fair_blocks": good.astype(np.int32), "is_fair": good == blocks,
                "fair_so_far": so_far, "pct_so_far": so_far * 100 / (numbers * blocks),
            }
            if with_items:
                record["window_items"] = [names[labels[i:i + window]].tolist() for i in range(count)]
            windows, fair = windows + count, int(so_far[-1])
            yield pd.DataFrame(record)
        group.update((labels[max(0, len(labels) - window + 1):].tolist(), windows, fair))

    return _keyed(narrow, keys).applyInPandasWithState(
        step, StructType(out), state, "append", GroupStateTimeout.NoTimeout
    )


def stream_repair(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], attr: str, bounds: Bounds,
                  window: int, landmark: int, primary: str = "optimal", max_windows: int | None = None,
                  flush_after_ms: int | None = None, closes: str | None = None) -> DataFrame:
    """Rows in repaired order: (keys, out_pos, arrival, category, value); ``value`` is the whole row as JSON.

    Rows leave once their window moved on. A key's last rows are released when a row comes with a true ``closes``
    column, the last one of its key (the end of a bounded replay), or after ``flush_after_ms`` without any row.
    """
    check_window(window, bounds.block)
    chosen = strategy(primary)
    if chosen.needs_whole_blocks and (window + landmark) % bounds.block:
        raise ValueError(f"{primary} needs a block size that divides window + landmark")
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    ends = F.coalesce(F.col(closes), F.lit(False)) if closes else F.lit(False)
    narrow = df.select(*keys, *order_by, bounds.label_index(attr).alias("_g"), body.alias("_value"), ends.alias("_end"))
    out = StructType(narrow.select(*keys).schema.fields + StructType.fromDDL(
        "out_pos bigint, arrival bigint, category string, value string").fields)
    state = StructType.fromDDL(
        "arrivals array<bigint>, labels array<int>, bodies array<string>, start bigint, settled bigint, "
        "windows bigint, fair_checks bigint, edits bigint, seen bigint"
    )
    floor, ceiling, names = np.array(bounds.floor), np.array(bounds.ceiling), np.array(bounds.categories)

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        run = Episode(window, landmark, bounds.block, floor, ceiling,
                      template_function(chosen, bounds, window), max_windows)
        bodies, seen = {}, 0
        if group.exists:
            arrivals, labels, texts, run.start, run.settled, run.windows, run.fair_checks, run.edits, seen = group.get
            run.rows, run.labels = np.array(arrivals, dtype=np.int64), np.array(labels, dtype=np.int64)
            bodies = dict(zip(arrivals, texts, strict=True))
        first = run.settled
        kinds = {}
        if group.hasTimedOut:
            left = run.labels
            ready = run.finish()
            kinds = dict(zip(ready.tolist(), left.tolist(), strict=True))
        else:
            fresh = _in_order(batches, order_by)
            ids = seen + np.arange(len(fresh))
            if not run.stopped:
                bodies |= dict(zip(ids.tolist(), fresh["_value"], strict=True))
            run.feed(ids, fresh["_g"].to_numpy(dtype=np.int64))
            seen += len(fresh)
            labels_before = dict(zip(run.rows.tolist(), run.labels.tolist(), strict=True))
            over = run.stopped or bool(fresh["_end"].any())
            ready = np.concatenate([run.take(), run.finish()]) if over else run.take()
            kinds = labels_before
        if len(ready):
            yield pd.DataFrame({name: [value] * len(ready) for name, value in zip(keys, key, strict=True)} | {
                "out_pos": first + np.arange(len(ready)), "arrival": ready,
                "category": names[[kinds[r] for r in ready.tolist()]],
                "value": [bodies[r] for r in ready.tolist()],
            })
        group.update((
            run.rows.tolist(), run.labels.tolist(), [bodies[r] for r in run.rows.tolist()], int(run.start),
            int(run.settled), int(run.windows), int(run.fair_checks), int(run.edits), int(seen),
        ))
        if flush_after_ms is not None and not group.hasTimedOut:
            group.setTimeoutDuration(flush_after_ms)

    timeout = GroupStateTimeout.NoTimeout if flush_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return _keyed(narrow, keys).applyInPandasWithState(step, out, state, "append", timeout)


def _keyed(df: DataFrame, keys: Sequence[str]):
    if not keys:
        raise ValueError("streaming operators need a stream key; add a constant one if there is a single stream")
    return df.groupBy(*keys)


def _in_order(batches: Iterator[pd.DataFrame], order_by: Sequence[str]) -> pd.DataFrame:
    parts = list(batches)
    rows = pd.concat(parts, ignore_index=True) if len(parts) != 1 else parts[0]
    return rows.sort_values(list(order_by), kind="stable")

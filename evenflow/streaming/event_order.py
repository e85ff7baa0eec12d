"""Event-time order for streams whose rows arrive out of order, with a side output for late rows.

Every key has a reorder buffer and a watermark of its own: the largest event time of its earlier
micro-batches less ``delay``. A row below it is late. After a micro-batch the watermark moves on and the rows below it
leave the buffer in order, so later rows can only follow them. Spark's own watermark would discard late rows before an
operator sees them, and a slow key would lose rows to a fast one; here they come out, marked and counted.

Keys are dealt into groups by hash, and a group's buffer and progress are kept in the state store (RocksDB) as Arrow
data: one call per group and micro-batch, however many keys there are. Late rows of a micro-batch leave at once; a task
holds the other rows of one group while it releases those that the watermarks have passed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Groups that the keys of a stream are dealt into, and rows that one value of the state holds at most.
GROUPS, PACK_ROWS = 1024, 1 << 13
#: No event time yet, and no timer.
NOTHING, NEVER = -(1 << 63), (1 << 63) - 1


@contextmanager
def list_states(spark: SparkSession):
    """Start queries of this module inside: list states need the RocksDB state store."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Order(StatefulProcessor):
    """All keys of a group at once: columns ``k<i>`` are key values, ``n<i>`` tell which of them are null."""

    def __init__(self, keys: list[str], order_by: list[str], delay_us: int, idle_ms: int | None):
        self.keys, self.order_by, self.delay_us, self.idle_ms = keys, order_by, delay_us, idle_ms
        self.by = [f"{c}{i}" for i in range(len(keys)) for c in "kn"]
        self.sorting = ["us", *(f"o{i}" for i in range(len(order_by)))]
        self.columns = [*self.by, *self.sorting, "body"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "rows binary")
        self.progress = handle.getValueState("progress", "keys binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = _unpacked(self.progress.get()[0]) if self.progress.exists() else None
        waiting, over = [], []
        for batch in rows:
            if batch.empty:
                continue
            known = self._known(before, batch)
            number = self._numbers(known, batch)
            # Late is what lies behind the watermark that the earlier micro-batches left.
            mark = known["mark"].to_numpy()[number]
            behind = batch["us"].to_numpy() < mark
            if behind.any():
                own, late = batch[behind], known["late"].to_numpy()
                yield self._out(own, late[number[behind]] + 1 + own.groupby(number[behind]).cumcount().to_numpy(), True)
                known["late"] = late + np.bincount(number[behind], minlength=len(known))
            newest = known["newest"].to_numpy().copy()
            np.maximum.at(newest, number, batch["us"].to_numpy())
            known["newest"] = newest
            if self.idle_ms is not None:
                known.loc[np.unique(number), "idle_at"] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            waiting.append(batch.loc[~behind, self.columns])
            over.append(known.loc[np.unique(number[batch["ends"].to_numpy()]), self.by])
            before = known
        if before is None:
            return
        ends = np.zeros(len(before), dtype=bool)
        ends[self._numbers(before, pd.concat(over))] = True
        yield from self._release(before, pd.concat(waiting), ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Some keys were idle: all that waits of them leaves, and their watermark moves to their newest row."""
        known = _unpacked(self.progress.get()[0])
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        idle = known["idle_at"].to_numpy() <= now
        known.loc[idle, "newest"] += self.delay_us
        known.loc[idle, "idle_at"] = NEVER
        yield from self._release(known, None, idle)

    def _known(self, known: pd.DataFrame | None, batch: pd.DataFrame) -> pd.DataFrame:
        """Progress of all keys so far and, with nothing behind them, of those that are new in the batch."""
        fresh = batch[self.by].drop_duplicates()
        if known is not None:
            fresh = pd.concat([known[self.by], fresh]).drop_duplicates().iloc[len(known):]
        begun = fresh.assign(newest=NOTHING, mark=NOTHING, place=0, late=0, idle_at=NEVER)
        return (begun if known is None else pd.concat([known, begun])).reset_index(drop=True)

    def _numbers(self, known: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        """Place of each row's key in ``known``, which has every key once."""
        both = pd.concat([known[self.by], rows[self.by]], ignore_index=True)
        return both.groupby(self.by, dropna=False, sort=False).ngroup().to_numpy()[len(known):]

    def _release(self, known: pd.DataFrame, waiting: pd.DataFrame | None, whole: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows below their key's watermark leave, and all rows of the keys that ``whole`` marks."""
        known["mark"] = known["newest"] - self.delay_us
        stored = [_unpacked(r[0]) for r in self.buffer.get()] if self.buffer.exists() else []
        held = pd.concat([*stored, *([] if waiting is None else [waiting])], ignore_index=True) if stored or waiting is not None else None
        if held is not None and len(held):
            number = self._numbers(known, held)
            ready = whole[number] | (held["us"].to_numpy() < known["mark"].to_numpy()[number])
            if ready.any():
                leaving = held[ready].assign(_number=number[ready]).sort_values(["_number", *self.sorting], kind="stable")
                number, place = leaving["_number"].to_numpy(), known["place"].to_numpy()
                yield self._out(leaving, place[number] + leaving.groupby("_number").cumcount().to_numpy(), False)
                known["place"] = place + np.bincount(number, minlength=len(known))
                left = held[~ready]
                if len(left):
                    self.buffer.put(_packed(left))
                elif stored:
                    self.buffer.clear()
            elif waiting is not None and len(waiting):
                self.buffer.appendList(_packed(waiting))
        self.progress.update(_packed(known, len(known))[0])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            first = int(known["idle_at"].min())
            if first < NEVER:
                self.handle.registerTimer(first)

    def _out(self, rows: pd.DataFrame, number: np.ndarray, late: bool) -> pd.DataFrame:
        out = {}
        for i, name in enumerate(self.keys):
            missing = rows[f"n{i}"].to_numpy(dtype=bool)
            out[name] = rows[f"k{i}"].astype(object).where(~missing, None).to_numpy() if missing.any() else rows[f"k{i}"].to_numpy()
        for i, name in enumerate(self.order_by):
            out[name] = rows[f"o{i}"].to_numpy()
        return pd.DataFrame(out | {"place": number, "late": late, "value": rows["body"].to_numpy()})

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame, most: int = PACK_ROWS) -> list[tuple[bytes]]:
    """Rows as Arrow data, so that the state store gets few large values."""
    table, packs = pa.Table.from_pandas(rows, preserve_index=False), []
    for begin in range(0, len(rows), most):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(begin, most))
        packs.append((sink.getvalue().to_pybytes(),))
    return packs


def _unpacked(pack: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(bytes(pack)) as reader:
        return reader.read_all().to_pandas()


def order_events(df: DataFrame, keys: Sequence[str], event_time: str, order_by: Sequence[str], delay_ms: int, closes: str | None = None,
                 idle_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """(keys, order_by, place, late, value) of every row of a stream, once; ``value`` is the whole row as JSON.

    On time, ``place`` counts a key's rows from 0 in the order of ``event_time`` and then ``order_by``, which must be
    long or string columns without nulls. A row is late when its event time lies more than ``delay_ms`` behind the newest of its
    key's earlier micro-batches; its ``place`` counts the key's late rows from 1. Rows without event time are late.

    Rows wait until the watermark has passed them, until a row with a true ``closes`` column ends their key (as the
    last one of a bounded replay does), or until the key had no row for ``idle_ms``. Start the query inside
    ``list_states``.

    Keys share state in ``groups`` groups, so that a key with few rows costs no calls of its own; a task holds one
    group's waiting rows. The number must stay the same as long as the checkpoint is used.
    """
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    time = F.coalesce(F.unix_micros(F.col(event_time).cast("timestamp")), F.lit(-(1 << 62)))
    ends = F.coalesce(F.col(closes), F.lit(False)) if closes else F.lit(False)
    # State and pandas see plain names, whatever the table's are, and no nulls that would turn a long into a double.
    ordering = [F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)]
    named = [x for i, k in enumerate(keys) for x in (_filled(df, k).alias(f"k{i}"), F.col(k).isNull().alias(f"n{i}"))]
    group = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(groups)).alias("group")
    rows = df.select(group, *named, time.alias("us"), *ordering, body.alias("body"), ends.alias("ends"))
    out = StructType(df.select(*keys, *order_by).schema.fields + StructType.fromDDL("place bigint, late boolean, value string").fields)
    processor = _Order(list(keys), list(order_by), delay_ms * 1000, idle_ms)
    return rows.groupBy("group").transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if idle_ms is not None else "None")


def _filled(df: DataFrame, key: str) -> Column:
    kind = df.select(key).schema[0].dataType
    return F.coalesce(F.col(key), F.lit(0).cast(kind)) if isinstance(kind, IntegralType) else F.col(key)

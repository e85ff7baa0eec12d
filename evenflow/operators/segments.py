"""Windowed repair of one giant stream by many tasks, with the result of the one sequential run.

A repair depends on earlier ones only by the next window start and the rows they carried on, at most one window of
them. So a stream is cut into segments that run at the same time, each from a guess of that state: the run starts some
rows earlier, untouched, and what it carries over the segment's begin is the guess. Runs that agree at one point agree
from there on. Where the guess differs from what the segment before really carried on, the segment runs again from
that, and neighbours that both must run again do so as one stretch, row by row in one task. The first segment that is
wrong is right after its rerun, so the rounds come to an end. Runs meet where fair windows fill as many rows as a window
has. On a stream that is hardly ever fair they may never meet: then the guesses were for nothing and the second round is
the sequential run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenflow.operators.bounds import Bounds, check_places
from evenflow.operators.monitor import check_window
from evenflow.operators.order import OrderedStream, null_safe_join, spread
from evenflow.operators.stateful import DELIVERED, EDIT, LOG_FIELDS, SUMMARY, RepairTrace, row_stretches
from evenflow.plans.episode import Edit, Episode
from evenflow.plans.registry import strategy, template_function
from evenflow.session import materialize

GUESS, CARRY = "guess", "carry"
PIECE = 1 << 13  # rows of one delivery entry


def segmented_repair(stream: OrderedStream, attr: str, bounds: Bounds, window: int, landmark: int,
                     primary: str = "optimal", log_edits: bool = True, segment_rows: int = 1 << 16,
                     warm_up: int | None = None) -> RepairTrace:
    """``stateful_repair`` without a bound on windows, for streams of any length under one key; equal rows and edits.

    A guessing task holds one segment of ``segment_rows`` rows, the ``warm_up`` rows before it (by default 16 chunks) and
    one chunk behind it; a later one streams. The driver asks each round only whether a segment is left to be run again.
    """
    check_window(window, bounds.block)
    check_places(bounds)
    if segment_rows < window + landmark:
        raise ValueError("a segment must hold at least one window and landmark")
    if strategy(primary).needs_whole_blocks and (window + landmark) % bounds.block:
        raise ValueError(f"{primary} needs a block size that divides window + landmark")
    warm_up = 16 * (window + landmark) if warm_up is None else warm_up
    by = [*stream.keys, "episode", "segment"]
    rows = _segment_rows(stream, bounds, attr, segment_rows, warm_up, window + landmark)
    schema = StructType(rows.select(*by).schema.fields + StructType.fromDDL(LOG_FIELDS).fields)
    setting = (by[:-1], to_arrow_schema(schema), bounds, window, landmark, strategy(primary), log_edits, segment_rows, warm_up)
    guess, stretch = _GuessRunner(*setting), _StretchRunner(*setting)

    def guessed(group: pa.Table) -> pa.Table:
        return guess(group)

    logs = [materialize(rows.groupBy(*by).applyInArrow(guessed, schema)).withColumn("_round", F.lit(0))]
    latest = materialize(_states(logs[0], by))
    while not (wrong := materialize(_unmatched(latest, by, 2 ** (len(logs) - 1) - 1))).isEmpty():
        again = _stretch_rows(rows, wrong, by, segment_rows)
        sort = [*by[:-1], "_stretch"]
        log = materialize(spread(again, sort).sortWithinPartitions(*sort, "row").mapInArrow(stretch, schema))
        logs.append(log.withColumn("_round", F.lit(len(logs))))
        kept = null_safe_join(latest, wrong.select(*by), by, "left_anti")
        latest = materialize(kept.unionByName(_states(logs[-1], by)))
    log = null_safe_join(reduce(DataFrame.unionByName, logs), latest.select(*by, "_round"), [*by, "_round"])
    return RepairTrace(_one_run(log, by), stream, attr, bounds, window, landmark)


def _segment_rows(stream: OrderedStream, bounds: Bounds, attr: str, size: int, before: int, behind: int) -> DataFrame:
    """(keys, episode, segment, row, g): rows near a border go to every segment that looks at them."""
    pos = F.col(stream.pos)
    first = F.greatest(F.lit(0).cast("long"), F.floor((pos - behind) / size).cast("long"))
    last = F.expr(f"(`{stream.pos}` + {before}) div {size}")
    return stream.df.select(
        *stream.keys, F.lit(0).cast("long").alias("episode"), F.explode(F.sequence(first, last)).alias("segment"),
        pos.alias("row"), bounds.label_index(attr).alias("g"),
    )


def _states(log: DataFrame, by: list[str]) -> DataFrame:
    """One row per segment: the state it started from and the one it carried on."""
    state = F.struct("number", "rows", "labels")
    return log.where(F.col("kind").isin(GUESS, CARRY)).groupBy(*by, "_round").agg(
        F.max(F.when(F.col("kind") == GUESS, state)).alias("_guess"),
        F.max(F.when(F.col("kind") == CARRY, state)).alias("_carry"),
    )


def _unmatched(latest: DataFrame, by: list[str], further: int) -> DataFrame:
    """Segments that did not start from what the one before carried on, with the state they must start from and the
    stretch of such segments they lie in. ``further`` segments behind each are taken along, in case a new state spoils
    their guess: doubled every round, so that one wrong state moves on in few rounds.
    """
    before = latest.select(*by[:-1], (F.col("segment") + 1).alias("segment"), F.col("_carry").alias("_told"))
    joined = null_safe_join(latest.select(*by, "_guess"), before, by)
    behind = Window.partitionBy(*by[:-1]).orderBy("segment").rowsBetween(-further, 0)
    near = joined.withColumn("_wrong", F.max(~F.col("_guess").eqNullSafe(F.col("_told"))).over(behind))
    wrong = near.where("_wrong").select(*by, "_told.number", "_told.rows", "_told.labels")
    number = F.row_number().over(Window.partitionBy(*by[:-1]).orderBy("segment"))
    together = Window.partitionBy(*by[:-1], "_group")
    return wrong.withColumn("_group", F.col("segment") - number).select(
        *wrong.columns, F.min("segment").over(together).alias("_stretch"), F.max("segment").over(together).alias("_last"))


def _stretch_rows(rows: DataFrame, wrong: DataFrame, by: list[str], size: int) -> DataFrame:
    """Every row of a stretch once, the chunk behind its last segment, and first of all a row with its state."""
    none = {"number": F.lit(None).cast("long"), "rows": F.lit(None).cast("array<long>"), "labels": F.lit(None).cast("array<int>")}
    own = null_safe_join(rows, wrong.select(*by, "_stretch", "_last"), by).where(
        f"row div {size} = segment or (segment = _last and row div {size} > segment)").drop("segment").withColumns(none)
    heads = wrong.where("segment = _stretch").drop("segment").withColumns(
        {"row": F.lit(-1).cast("long"), "g": F.lit(-1).cast("int")})
    return own.unionByName(heads)


def _one_run(log: DataFrame, by: list[str]) -> DataFrame:
    """The segments' logs as the log of one run: edits counted through, one summary."""
    run = by[:-1]
    sums = log.where(F.col("kind") == SUMMARY)
    earlier = Window.partitionBy(*run).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, F.coalesce(F.sum(F.col("rows")[0]).over(earlier), F.lit(0)).alias("_edits"))
    numbered = null_safe_join(log.where(F.col("kind").isin(DELIVERED, EDIT)), offsets, by)
    fields = ["kind", "number", "rows", "labels", "order"]
    entries = numbered.withColumn(
        "number", F.col("number") + F.when(F.col("kind") == EDIT, F.col("_edits")).otherwise(0)).select(*run, *fields)
    total = sums.groupBy(*run).agg(F.array(*[F.sum(F.col("rows")[i]) for i in range(3)]).alias("rows")).select(
        *run, F.lit(SUMMARY).alias("kind"), F.lit(None).cast("long").alias("number"), "rows",
        F.lit(None).cast("array<int>").alias("labels"), F.lit(None).cast("array<int>").alias("order"))
    return entries.unionByName(total)


class _Runner:
    def __init__(self, keys, schema, bounds, window, landmark, primary, log_edits, size, warm_up):
        self.keys, self.schema, self.bounds, self.primary, self.log_edits = keys, schema, bounds, primary, log_edits
        self.window, self.landmark, self.size, self.warm_up = window, landmark, size, warm_up

    def _episode(self, at: int, until: int) -> Episode:
        b = self.bounds
        return Episode(self.window, self.landmark, b.block, np.array(b.floor), np.array(b.ceiling),
                       template_function(self.primary, b, self.window), until=until, settled=at)

    def _batch(self, key: list[pa.Scalar], segment: int, entries: list[tuple]) -> pa.RecordBatch:
        columns = [pa.repeat(value, len(entries)) for value in [*key, pa.scalar(segment)]]
        columns += [pa.array(list(column), self.schema.field(len(columns) + i).type)
                    for i, column in enumerate(zip(*entries, strict=True))]
        arrays = [c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def _edits(self, edits: list[Edit]) -> list[tuple]:
        return [(EDIT, e.number, e.before, e.labels, e.order) for e in edits] if self.log_edits else []


def _delivered(run: Episode, end: int) -> list[tuple]:
    """Hand out the rows before ``end``."""
    entries = [(DELIVERED, run.settled + i, run.rows[i:min(end, i + PIECE)], None, None) for i in range(0, end, PIECE)]
    run.rows, run.labels = run.rows[end:], run.labels[end:]
    run.settled, run.start = run.settled + end, 0
    return entries


def _sums(run: Episode) -> tuple:
    """The sums of a segment; the next one counts from zero."""
    sums = np.array([run.edits, run.fair_checks, run.windows])
    run.edits = run.fair_checks = run.windows = 0
    return (SUMMARY, None, sums, None, None)


#: A run that came to the stream's end earlier leaves a segment nothing to do.
OVER = (None, [], [], None)
NOTHING = [(GUESS, *OVER), (CARRY, *OVER), (SUMMARY, None, [0, 0, 0], None, None)]


class _GuessRunner(_Runner):
    """Runs one segment; the state it starts from is what a run from some rows earlier carries over its begin."""

    def __call__(self, group: pa.Table) -> pa.Table:
        rows, labels = group.column("row").to_numpy(), group.column("g").to_numpy().astype(np.int64)
        order = np.argsort(rows)
        segment = group.column("segment")[0].as_py()
        begin = segment * self.size
        run = self._episode(int(rows[order[0]]), begin)
        run.feed(rows[order], labels[order])
        key = [group.column(c)[0] for c in self.keys]
        if not run.stopped:
            return pa.Table.from_batches([self._batch(key, segment, NOTHING)])
        if not len(run.rows):  # no row lies before the segment, so none was read
            run.rows, run.labels = rows[order], labels[order]
        _sums(run)
        entries = [(GUESS, *run.carried(), None)]
        _delivered(run, run.start)  # belongs to the segments before
        run.until = begin + self.size
        entries += self._edits(run.feed(np.empty(0, np.int64), np.empty(0, np.int64)))
        entries += [(CARRY, *(run.carried() if run.stopped else OVER[:3]), None), _sums(run)]
        entries += _delivered(run, run.start if run.stopped else len(run.rows))
        return pa.Table.from_batches([self._batch(key, segment, entries)])


class _StretchRunner(_Runner):
    """Walks the sorted rows of stretches of segments, each headed by a row with the state to start from."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, run, carried, reach, segment, last = None, None, None, 0, 0, -1
        for batch in batches:
            rows, labels = batch.column("row").to_numpy(), batch.column("g").to_numpy().astype(np.int64)
            for begin, end in row_stretches(batch, [*self.keys, "_stretch"]):
                here = [batch.column(c)[begin] for c in (*self.keys, "_stretch")]
                if here != stretch:
                    if stretch is not None:
                        yield from self._close(stretch[:-1], run, segment, last)
                    stretch, segment, last = here, here[-1].as_py(), batch.column("_last")[begin].as_py()
                    run, carried = None, None
                    if (at := batch.column("number")[begin].as_py()) is not None:
                        run = self._episode(at, (segment + 1) * self.size)
                        carried = [np.array(batch.column(c)[begin].as_py(), dtype=np.int64) for c in ("rows", "labels")]
                        reach = at + len(carried[0])
                        yield self._batch(here[:-1], segment, [(GUESS, at, *carried, None)])
                    begin += 1
                if run is None or segment > last:
                    continue
                fresh = rows[begin:end] >= reach
                kept, named = rows[begin:end][fresh], labels[begin:end][fresh]
                if carried is not None:  # these rows stand in for as many of the table's
                    kept, named = np.concatenate([carried[0], kept]), np.concatenate([carried[1], named])
                    carried = None
                edits = run.feed(kept, named)
                while run.stopped and segment <= last:
                    state = (*run.carried(), None)
                    yield self._batch(stretch[:-1], segment, [
                        *self._edits(edits), (CARRY, *state), _sums(run), *_delivered(run, run.start)])
                    segment += 1
                    if segment <= last:
                        yield self._batch(stretch[:-1], segment, [(GUESS, *state)])
                        run.until += self.size
                        edits = run.feed(np.empty(0, np.int64), np.empty(0, np.int64))
                if segment <= last and (entries := [*self._edits(edits), *_delivered(run, run.start)]):
                    yield self._batch(stretch[:-1], segment, entries)
        if stretch is not None:
            yield from self._close(stretch[:-1], run, segment, last)

    def _close(self, key, run: Episode | None, segment: int, last: int) -> Iterator[pa.RecordBatch]:
        """The stream ended inside a segment, or before the first one of the stretch."""
        if run is not None and segment <= last:
            yield self._batch(key, segment, [(CARRY, *OVER), _sums(run), *_delivered(run, len(run.rows))])
            segment += 1
        for rest in range(segment, last + 1):
            yield self._batch(key, rest, NOTHING)

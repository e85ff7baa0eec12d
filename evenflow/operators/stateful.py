"""Stateful windowed repair over batch tables.

Each repair depends on the rows the previous one carried on, so a stream key is one sequential run: a task streams
through its sorted rows and keeps one window plus landmark in memory. Many keys spread over the cluster; one giant
stream is the business of ``cut_chunks`` and ``repair_chunks``, which carry nothing. A caller may ask for independent
restarts every so many rows, which makes another result. Python sees only (episode, position, label index).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenflow.operators.bounds import Bounds, check_places
from evenflow.operators.monitor import check_window
from evenflow.operators.order import OrderedStream, int_div, null_safe_join, spread
from evenflow.operators.repair import case_scores, plan_scores, plan_templates
from evenflow.plans.episode import Edit, Episode
from evenflow.plans.registry import strategy, template_function
from evenflow.session import materialize

DELIVERED, EDIT, SUMMARY = "delivered", "edit", "summary"
LOG_FIELDS = "kind string, number bigint, rows array<bigint>, labels array<int>, `order` array<int>"


@dataclass(frozen=True)
class RepairTrace:
    """Narrow log of all runs, keyed by (stream keys, episode); rows are named by their place in the episode.

    ``delivered``: ``rows`` leave the window for good, the first one at place ``number``. ``edit``: chunk
    ``number`` held ``rows`` with ``labels`` and was rearranged to ``rows[order]``. ``summary``: edits, fair
    checks and windows covered.
    """

    df: DataFrame
    stream: OrderedStream
    attr: str
    bounds: Bounds
    window: int
    landmark: int
    restart_every: int | None = None
    stored: bool = False

    @property
    def by(self) -> list[str]:
        return [*self.stream.keys, "episode"]

    def materialized(self) -> RepairTrace:
        """The same trace, computed once: it is narrow, costs Python time and is read more than once."""
        return self if self.stored else replace(self, df=materialize(self.df), stored=True)

    def delivered(self, payload: Sequence[str] = ()) -> DataFrame:
        """Every row of the stream with its final place in the episode; wide columns are joined in the JVM."""
        log = self.df.where(F.col("kind") == DELIVERED).select(
            *self.by, "number", F.posexplode("rows").alias("_i", "row")
        )
        return self._with_rows(log.withColumn("out_pos", F.col("number") + F.col("_i")).drop("number", "_i"), payload)

    def captures(self, payload: Sequence[str] = ()) -> DataFrame:
        """Original and reordered chunks, one row per phase and chunk place."""
        place = F.posexplode(F.arrays_zip("rows", "order")).alias("_i", "_z")
        log = self.df.where(F.col("kind") == EDIT).select(*self.by, F.col("number").alias("edit_event"), "rows", place)
        sides = log.select(*self.by, "edit_event", F.col("_i").alias("position_in_chunk"), F.explode(F.array(
            F.struct(F.lit("original").alias("phase"), F.col("_z.rows").alias("row")),
            F.struct(F.lit("reordered").alias("phase"), F.get("rows", F.col("_z.order")).alias("row")),
        )).alias("_p"))
        return self._with_rows(
            sides.select(*self.by, "_p.phase", "edit_event", "position_in_chunk", "_p.row"), payload
        )

    def chunks(self) -> DataFrame:
        """Edited chunks as label arrays in original order."""
        return self.df.where(F.col("kind") == EDIT).select(*self.by, F.col("number").alias("edit_event"), "labels")

    def summaries(self) -> DataFrame:
        """Per episode: edits, already fair windows, windows covered."""
        return self.df.where(F.col("kind") == SUMMARY).select(*self.by, *[
            F.col("rows")[i].alias(name) for i, name in enumerate(("edits", "fair_checks", "windows_covered"))
        ])

    def _with_rows(self, log: DataFrame, payload: Sequence[str]) -> DataFrame:
        named = _episodes(self.stream, self.restart_every).select(
            *self.by, "row", F.col(self.stream.pos), F.col(self.attr).cast("string").alias("category"),
            *[c for c in payload if c not in (self.attr, self.stream.pos)],
        )
        return null_safe_join(log, named, [*self.by, "row"]).drop("row")


def _episodes(stream: OrderedStream, restart_every: int | None) -> DataFrame:
    if restart_every is None:
        return stream.df.withColumns({"episode": F.lit(0).cast("long"), "row": F.col(stream.pos)})
    return stream.df.withColumns({
        "episode": int_div(stream.pos, restart_every), "row": F.col(stream.pos) % restart_every
    })


def stateful_repair(stream: OrderedStream, attr: str, bounds: Bounds, window: int, landmark: int,
                    primary: str = "optimal", max_windows: int | None = None, log_edits: bool = True,
                    restart_every: int | None = None) -> RepairTrace:
    """Run the windowed repair over every stream; ``primary`` decides the delivered order.

    Without ``max_windows`` every row is delivered. With it, each run stops once it covered that many windows and
    reads nothing beyond them. Edited chunks overlap, so ``log_edits=False`` keeps the log at one entry per row when
    only the delivery matters. ``restart_every`` cuts a stream into independent runs of that many rows: nothing is
    carried over a cut and no window crosses it.
    """
    check_window(window, bounds.block)
    check_places(bounds)
    if max_windows is not None:  # a window costs one row, the last repair X more
        stream = stream.with_df(stream.df.where(F.col(stream.pos) < max_windows + window + landmark))
    if restart_every is not None and window + landmark > restart_every:
        raise ValueError("a run must hold at least one window and landmark")
    if strategy(primary).needs_whole_blocks and (window + landmark) % bounds.block:
        raise ValueError(f"{primary} needs a block size that divides window + landmark")
    by = [*stream.keys, "episode"]
    narrow = _episodes(stream, restart_every).select(*by, "row", bounds.label_index(attr).alias("g"))
    schema = StructType(narrow.select(*by).schema.fields + StructType.fromDDL(LOG_FIELDS).fields)
    runner = _EpisodeRunner(
        by, to_arrow_schema(schema), bounds, window, landmark, strategy(primary), max_windows, log_edits
    )
    log = spread(narrow, by).sortWithinPartitions(*by, "row").mapInArrow(runner, schema)
    return RepairTrace(log, stream, attr, bounds, window, landmark, restart_every)


def row_stretches(batch: pa.RecordBatch, by: Sequence[str]) -> list[tuple[int, int]]:
    """Row ranges of a sorted batch that belong to one key."""
    changes = np.zeros(batch.num_rows, dtype=bool)
    for name in by:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        changes[1:] |= codes[1:] != codes[:-1]
    edges = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _new_episode(bounds: Bounds, window: int, landmark: int, template, max_windows: int | None) -> Episode:
    return Episode(window, landmark, bounds.block, np.array(bounds.floor), np.array(bounds.ceiling), template, max_windows)


class _EpisodeRunner:
    """Walks the sorted rows of a task; an episode may span Arrow batches."""

    def __init__(self, by, schema, bounds, window, landmark, primary, max_windows, log_edits):
        self.by, self.schema, self.bounds, self.log_edits = by, schema, bounds, log_edits
        self.window, self.landmark, self.primary, self.max_windows = window, landmark, primary, max_windows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_run = self._starter()
        key, run = None, None
        for batch in batches:
            rows = batch.column("row").to_numpy()
            labels = batch.column("g").to_numpy()
            for begin, end in row_stretches(batch, self.by):
                here = [batch.column(c)[begin] for c in self.by]
                if here != key:
                    if run is not None:
                        yield self._finish(key, run)
                    key, run = here, new_run(here)
                edits = run.feed(rows[begin:end], labels[begin:end].astype(np.int64))
                yield self._log(key, run, edits)
        if run is not None:
            yield self._finish(key, run)

    def _starter(self) -> Callable[[list], Episode]:
        """key -> its new run; chunks with equal counts share a template within the task."""
        template = template_function(self.primary, self.bounds, self.window)
        return lambda key: _new_episode(self.bounds, self.window, self.landmark, template, self.max_windows)

    def _log(self, key, run: Episode, edits: list[Edit]) -> pa.RecordBatch:
        first = run.settled
        entries = [(DELIVERED, first, run.take(), None, None)]
        if self.log_edits:
            entries += [(EDIT, e.number, e.before, e.labels, e.order) for e in edits]
        return self._batch(key, entries)

    def _finish(self, key, run: Episode) -> pa.RecordBatch:
        first = run.settled
        return self._batch(key, [
            (DELIVERED, first, run.finish(), None, None),
            (SUMMARY, None, np.array([run.edits, run.fair_checks, run.windows]), None, None),
        ])

    def _batch(self, key, entries) -> pa.RecordBatch:
        columns = [pa.repeat(value, len(entries)) for value in key]
        columns += [pa.array(list(column), self.schema.field(len(key) + i).type)
                    for i, column in enumerate(zip(*entries, strict=True))]
        arrays = [c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def compare_strategies(trace: RepairTrace, strategies: Sequence[str]) -> DataFrame:
    """Every strategy's template on the same original chunks; the trace's primary strategy drove the stream.

    ``before`` (the untouched chunk) is always part of the comparison.
    """
    names = ["before", *[s for s in strategies if s != "before"]]
    return plan_templates(trace.chunks(), "labels", names, trace.bounds, trace.window, trace.landmark)


def strategy_metrics(trace: RepairTrace, strategies: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """Fairness before and after per strategy, in corrected and in run-report ("compat") form.

    The run report counts the blocks of every check and of every edited chunk (so a trigger window counts
    twice), and adds already fair windows to the *before* side only.
    """
    trace = trace.materialized()
    by = list(trace.by if by is None else by)
    names = ["before", *[s for s in strategies if s != "before"]]
    scores = plan_scores(trace.chunks(), "labels", names, trace.bounds, trace.window, trace.landmark)
    blocks = check_window(trace.window, trace.bounds.block)
    return _run_report(scores, trace.summaries(), by, F.lit(blocks), F.lit(trace.landmark))


def _run_report(scores: DataFrame, summaries: DataFrame, by: list[str], blocks: Column, landmark: Column) -> DataFrame:
    after = scores.groupBy(*by, "strategy").agg(
        *[F.sum(c).alias(c) for c in ("windows", "fair_blocks", "fair_windows")],
        F.sum("changed").alias("total_swaps"),
    )
    runs = summaries.groupBy(*by).agg(F.sum("edits").alias("edits"), F.sum("fair_checks").alias("fair_checks"))
    joined = null_safe_join(after, runs, by) if by else after.crossJoin(F.broadcast(runs))  # one totals row
    on = [*by, "strategy"]
    checks = F.col("fair_checks") + F.col("edits")
    is_before = F.col("strategy") == "before"
    fair_rest = F.col("fair_checks") * blocks
    compat_fair = F.col("fair_blocks") + F.when(is_before, fair_rest).otherwise(0)
    compat_windows = F.col("windows") + F.when(is_before, F.col("fair_checks")).otherwise(0)
    compat_fair_windows = F.col("fair_windows") + F.when(is_before, F.col("fair_checks")).otherwise(0)
    compat_total = checks * blocks + F.col("edits") * blocks * (landmark + 1)
    covered = F.col("windows") + F.col("fair_checks")
    return joined.select(
        *on, "edits", "fair_checks", "total_swaps",
        compat_total.alias("compat_total_blocks"),
        compat_fair.alias("compat_fair_blocks"),
        (compat_fair * 100 / compat_total).alias("compat_pct_fair"),
        compat_windows.alias("compat_windows"),
        compat_fair_windows.alias("compat_fair_windows"),
        (compat_fair_windows * 100 / compat_windows).alias("compat_pct_fair_windows"),
        (covered * blocks).alias("total_blocks"),
        (F.col("fair_blocks") + fair_rest).alias("fair_blocks"),
        ((F.col("fair_blocks") + fair_rest) * 100 / (covered * blocks)).alias("pct_fair"),
        (F.col("fair_windows") + F.col("fair_checks")).alias("fair_windows"),
        ((F.col("fair_windows") + F.col("fair_checks")) * 100 / covered).alias("pct_fair_windows"),
    )


@dataclass(frozen=True)
class RepairCase:
    """One configuration of an experiment: sizes, bound on the windows of a run (None: the whole run), strategies."""

    window: int
    block: int
    landmark: int
    strategies: tuple[str, ...]
    max_windows: int | None = None

    @property
    def reach(self) -> int | None:
        """Rows that a run can touch: a window costs one row, the last repair X more."""
        return None if self.max_windows is None else self.max_windows + self.window + self.landmark


class _CaseRunner(_EpisodeRunner):
    """The last key column is the number of the case."""

    def __init__(self, by, schema, cases, bounds, primary):
        super().__init__(by, schema, None, None, None, primary, None, True)
        self.cases, self.case_bounds = cases, bounds

    def _starter(self) -> Callable[[list], Episode]:
        templates = [template_function(self.primary, b, c.window)
                     for c, b in zip(self.cases, self.case_bounds, strict=True)]

        def start(key: list) -> Episode:
            number = key[-1].as_py()
            case = self.cases[number]
            return _new_episode(self.case_bounds[number], case.window, case.landmark, templates[number],
                                case.max_windows)

        return start


def case_metrics(stream: OrderedStream, attr: str, counts: Mapping[str, int], cases: Sequence[RepairCase],
                 primary: str = "optimal") -> DataFrame:
    """(stream keys, ``case``, strategy, the columns of ``strategy_metrics``) for every case, in one job.

    The case is part of the key: one shuffle and one sort serve all cases, and every (run, case) is its own sequential
    run on some task. A row is repeated only for the cases that can reach it.
    """
    bounds = [Bounds.from_counts(counts, c.block) for c in cases]
    chosen = strategy(primary)
    for case, limits in zip(cases, bounds, strict=True):
        check_window(case.window, case.block)
        check_places(limits)
        if chosen.needs_whole_blocks and (case.window + case.landmark) % case.block:
            raise ValueError(f"{primary} needs a block size that divides window + landmark")
    by = [*stream.keys, "case"]
    reached = F.array(*[
        F.when(F.lit(True) if c.reach is None else F.col(stream.pos) < c.reach, F.lit(i)) for i, c in enumerate(cases)
    ])
    rows = stream.df if any(c.reach is None for c in cases) else stream.df.where(
        F.col(stream.pos) < max(c.reach for c in cases))
    narrow = rows.select(*stream.keys, F.col(stream.pos).alias("row"), bounds[0].label_index(attr).alias("g"),
                         F.explode(F.array_compact(reached)).alias("case"))
    schema = StructType(narrow.select(*by).schema.fields + StructType.fromDDL(LOG_FIELDS).fields)
    runner = _CaseRunner(by, to_arrow_schema(schema), tuple(cases), tuple(bounds), chosen)
    log = spread(narrow, by).sortWithinPartitions(*by, "row").mapInArrow(runner, schema)
    stored = materialize(log.where(F.col("kind") != DELIVERED))
    edits = stored.where(F.col("kind") == EDIT).select(*by, "labels")
    sides = [("before", *[s for s in c.strategies if s != "before"]) for c in cases]
    scores = case_scores(edits, "labels", "case", [
        (names, b, c.window, c.landmark) for names, b, c in zip(sides, bounds, cases, strict=True)])
    summaries = stored.where(F.col("kind") == SUMMARY).select(
        *by, F.col("rows")[0].alias("edits"), F.col("rows")[1].alias("fair_checks"))
    blocks, landmark = (F.get(F.array(*[F.lit(v) for v in values]), F.col("case")) for values in (
        [c.window // c.block for c in cases], [c.landmark for c in cases]))
    return _run_report(scores, summaries, by, blocks, landmark)

"""Chunk repair: reorder rows inside bounded chunks of W+X rows.

One shuffle brings a chunk together (at most W+X rows, a configured number). The planner answers with a
template; whole rows are attached to it by sorting both sides by (category, occurrence) and zipping them --
three built-in array functions, no self-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenflow.operators.bounds import Bounds, check_places
from evenflow.operators.monitor import check_window, chunk_scores
from evenflow.operators.order import OrderedStream, int_div, spread
from evenflow.plans.labels import fair_blocks_of_chunks
from evenflow.plans.optimal import longest_fair_length
from evenflow.plans.registry import Strategy, strategy, template_function

#: Labels of chunks that are planned and scored at once.
LABELS_TOGETHER = 1 << 20


@dataclass(frozen=True)
class Chunks:
    """One row per chunk: key columns and ``items`` = [(g, slot, payload...)] sorted by (g, slot)."""

    df: DataFrame
    by: tuple[str, ...]
    payload: tuple[str, ...]
    bounds: Bounds
    window: int
    landmark: int


def gather_chunks(df: DataFrame, by: Sequence[str], slot: str, attr: str, bounds: Bounds, window: int,
                  landmark: int, payload: Sequence[str] = ()) -> Chunks:
    """Bring the rows of each chunk together; ``by`` must name chunks of at most W+X rows."""
    check_window(window, bounds.block)
    check_places(bounds)
    item = F.struct(
        bounds.label_index(attr).alias("g"), F.col(slot).cast("int").alias("slot"), *[F.col(c) for c in payload]
    )
    narrow = spread(df.select(*by, item.alias("_item")), by)
    chunks = narrow.groupBy(*by).agg(F.sort_array(F.collect_list("_item")).alias("items"))
    return Chunks(chunks, tuple(by), tuple(payload), bounds, window, landmark)


def cut_chunks(stream: OrderedStream, attr: str, bounds: Bounds, window: int, landmark: int,
               payload: Sequence[str] = ()) -> Chunks:
    """Stateless chunks of W+X consecutive rows, so one giant stream is repaired in parallel.

    The last chunk of a stream may be shorter. The optimal strategy repairs it too; strategies that need whole
    blocks deliver it as it is.
    """
    size = window + landmark
    cut = stream.df.withColumn("chunk", int_div(stream.pos, size)).withColumn("_slot", F.col(stream.pos) % size)
    names = [stream.pos, *[c for c in payload if c != stream.pos]]
    return gather_chunks(cut, [*stream.keys, "chunk"], "_slot", attr, bounds, window, landmark, names)


def _makers(strategies: Sequence[Strategy], bounds: Bounds, window: int, landmark: int) -> list[Callable]:
    """labels -> template per strategy; a short chunk passes strategies that need whole blocks unedited."""
    def guarded(chosen: Strategy) -> Callable:
        make = template_function(chosen, bounds, window)
        if not chosen.needs_whole_blocks:
            return make
        return lambda labels: make(labels) if len(labels) == window + landmark else np.asarray(labels)

    return [guarded(s) for s in strategies]


def chunk_labels() -> Column:
    """Labels of a chunk in row order."""
    in_order = F.sort_array(F.transform("items", lambda x: F.struct(x.slot.alias("slot"), x.g.alias("g"))))
    return F.transform(in_order, lambda x: x.g)


def chunk_counts(bounds: Bounds) -> Column:
    """Category counts of a chunk."""
    def count(index: int) -> Column:
        return F.size(F.filter("items", lambda x: x.g == index))

    return F.array(*[count(i) for i in range(len(bounds.categories))])


def _check_lengths(strategies: Sequence[str], bounds: Bounds, window: int, landmark: int) -> None:
    for name in strategies:
        if strategy(name).needs_whole_blocks and (window + landmark) % bounds.block:
            raise ValueError(f"{name} needs a block size that divides window + landmark")


def plan_templates(df: DataFrame, labels: str, strategies: Sequence[str], bounds: Bounds, window: int,
                   landmark: int) -> DataFrame:
    """One row per input row and strategy, with its ``strategy`` and ``template``.

    All strategies of a chunk are planned by one Arrow UDF; plans that depend on counts only are remembered
    per task. The untouched order needs no planner.
    """
    _check_lengths(strategies, bounds, window, landmark)
    planned = [strategy(n) for n in strategies if n != "before"]

    def plan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        makers = _makers(planned, bounds, window, landmark)
        for series in batches:
            yield series.map(lambda chunk: [make(chunk).astype(np.int32) for make in makers])

    sides = []
    if "before" in strategies:
        sides.append(F.array(F.struct(F.lit("before").alias("strategy"), F.col(labels).alias("template"))))
    if planned:
        df = df.withColumn("_plans", F.pandas_udf(plan, "array<array<int>>")(F.col(labels)))
        names = F.array(*[F.lit(s.name) for s in planned])
        sides.append(F.zip_with(names, "_plans", lambda n, t: F.struct(n.alias("strategy"), t.alias("template"))))
    keep = [c for c in df.columns if c != "_plans"]
    return df.select(*keep, F.explode(F.concat(*sides)).alias("_s")).select(*keep, "_s.strategy", "_s.template")


def plan_scores(df: DataFrame, labels: str, strategies: Sequence[str], bounds: Bounds, window: int,
                landmark: int) -> DataFrame:
    """Like planning and then ``score_templates``, but the templates are scored where they were made.

    Columns: those of ``df`` without the labels, ``strategy``, ``windows``, ``fair_blocks``, ``fair_windows`` and
    ``changed``. Nothing is exploded, sorted or shuffled.
    """
    one = df.withColumn("_case", F.lit(0))
    return case_scores(one, labels, "_case", [(strategies, bounds, window, landmark)]).drop("_case")


def case_scores(df: DataFrame, labels: str, case: str,
                cases: Sequence[tuple[Sequence[str], Bounds, int, int]]) -> DataFrame:
    """``plan_scores`` for chunks of several configurations (strategies, bounds, window, landmark) in one pass.

    The column ``case`` says which of them a chunk belongs to.
    """
    for strategies, bounds, window, landmark in cases:
        _check_lengths(strategies, bounds, window, landmark)
    names = list(dict.fromkeys(n for strategies, *_ in cases for n in strategies))
    chosen = [[strategy(n) for n in strategies] for strategies, *_ in cases]
    places = [[names.index(n) for n in strategies] for strategies, *_ in cases]

    def scorer(number: int) -> Callable[[np.ndarray], np.ndarray]:
        """Chunks of one length to (chunks x strategies x figures)."""
        _, bounds, window, landmark = cases[number]
        floor, ceiling, blocks = np.array(bounds.floor), np.array(bounds.ceiling), window // bounds.block
        makers = _makers(chosen[number], bounds, window, landmark)
        many = [s.make_many(bounds, window) if s.make_many else None for s in chosen[number]]

        def score(place: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
            fair = fair_blocks_of_chunks(after, window, bounds.block, floor, ceiling)
            figures = fair.sum(axis=1), (fair == blocks).sum(axis=1), (before != after).sum(axis=1)
            return np.stack([np.full(len(before), place), np.full(len(before), fair.shape[1]), *figures], axis=1)

        def templates(chunks: np.ndarray, make: Callable, together: Callable | None) -> np.ndarray:
            if together is not None and chunks.shape[1] == window + landmark:
                return together(chunks)
            return np.stack([make(chunk) for chunk in chunks])

        return lambda chunks: np.stack([score(place, chunks, templates(chunks, make, together)) for place, make, together in zip(
            places[number], makers, many, strict=True)], axis=1)

    def plan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorers = [scorer(number) for number in range(len(cases))]
        for numbers, series in batches:
            found = np.empty(len(series), dtype=object)
            alike = pd.DataFrame({"case": numbers.to_numpy(), "length": [len(chunk) for chunk in series]})
            for (number, length), at in alike.groupby(["case", "length"]).indices.items():
                together = max(1, LABELS_TOGETHER // max(1, length))
                for some in (at[i:i + together] for i in range(0, len(at), together)):
                    figures = scorers[number](np.stack([series.iloc[i] for i in some])).tolist()
                    for i, one in zip(some, figures, strict=True):
                        found[i] = one
            yield pd.Series(found, dtype=object)

    scored = df.withColumn("_scores", F.pandas_udf(plan, "array<array<int>>")(F.col(case), F.col(labels)))
    named = scored.select(*[c for c in df.columns if c != labels], F.explode("_scores").alias("_s"))
    return named.select(*[c for c in named.columns if c != "_s"],
                        F.get(F.array(*[F.lit(n) for n in names]), F.col("_s")[0]).alias("strategy"), *[
        F.col("_s")[i].cast("long").alias(name)
        for i, name in enumerate(("windows", "fair_blocks", "fair_windows", "changed"), 1)
    ])


def repair_chunks(chunks: Chunks, strategies: Sequence[str] = ("optimal",)) -> DataFrame:
    """Rows of every chunk in repaired order, one copy per strategy.

    Columns: the chunk keys, ``strategy``, ``position_in_chunk``, ``source_position``, ``category``, payload.
    """
    labelled = chunks.df.withColumn("_labels", chunk_labels())
    planned = plan_templates(labelled, "_labels", strategies, chunks.bounds, chunks.window, chunks.landmark)
    seats = F.sort_array(F.transform("template", lambda g, i: F.struct(g.alias("g"), i.alias("place"))))
    zipped = planned.select(*chunks.by, "strategy", F.explode(F.arrays_zip(
        F.col("items").alias("item"), seats.alias("seat")
    )).alias("_z"))
    return zipped.select(
        *chunks.by, "strategy",
        F.col("_z.seat.place").alias("position_in_chunk"),
        F.col("_z.item.slot").alias("source_position"),
        category_of(F.col("_z.item.g"), chunks.bounds).alias("category"),
        *[F.col(f"_z.item.{c}").alias(c) for c in chunks.payload],
    )


def score_templates(plans: DataFrame, by: Sequence[str], labels: str, bounds: Bounds, window: int) -> DataFrame:
    """Score planned chunks over their X+1 windows and count the places whose label changed.

    Chunks are shuffled as arrays; the exploded rows then stay where they are for both window passes.
    """
    plans = spread(plans, [*by, "strategy"])
    changed = F.size(F.filter(F.zip_with(labels, "template", lambda a, b: a != b), lambda x: x))
    rows = plans.select(*by, "strategy", changed.alias("changed"), F.posexplode("template").alias("_place", "_g"))
    named = rows.withColumn("_category", category_of(F.col("_g"), bounds))
    return chunk_scores(named, [*by, "strategy", "changed"], "_category", bounds, window, "_place")


def category_of(index: Column, bounds: Bounds) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in bounds.categories]), index + 1)


def chunk_potential(chunks: Chunks) -> DataFrame:
    """Per chunk: counts, whether an exact fair tiling exists, copies of the target pattern with the remainder,
    and the longest all-fair region with the fair blocks it allows."""
    bounds, s = chunks.bounds, chunks.bounds.block
    floor, ceiling = np.array(bounds.floor), np.array(bounds.ceiling)

    @F.pandas_udf("int")
    def longest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered: dict[bytes, int] = {}
        for counts in batches:
            yield counts.map(lambda c: _remember(remembered, c, s, floor, ceiling)).astype("int32")

    base = chunks.df.select(*chunks.by, chunk_counts(bounds).alias("counts"))
    return base.select(
        *chunks.by, "counts", tileable_counts("counts", bounds).alias("tileable"),
        *pattern_columns("counts", bounds, chunks.window),
        longest("counts").alias("longest_fair"),
    ).withColumn("attainable_blocks", F.greatest(F.lit(0), F.col("longest_fair") - (s - 1)))


def _remember(seen: dict[bytes, int], counts: np.ndarray, block: int, floor: np.ndarray, ceiling: np.ndarray) -> int:
    key = counts.tobytes()
    if key not in seen:
        if len(seen) >= 65_536:
            seen.clear()
        seen[key] = longest_fair_length(counts.astype(np.int64), block, floor, ceiling)
    return seen[key]


def tileable_counts(counts: str, bounds: Bounds) -> Column:
    """Exact tiling test on a count array: M*floor <= count <= M*ceiling for M = N / s whole blocks."""
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    fits = total % bounds.block == 0
    for i, (low, high) in enumerate(zip(bounds.floor, bounds.ceiling, strict=True)):
        scaled = F.col(counts)[i] * bounds.block
        fits = fits & (scaled >= total * low) & (scaled <= total * high)
    return fits


def pattern_columns(counts: str, bounds: Bounds, window: int) -> list[Column]:
    """Copies of the target pattern a chunk holds, and the remainders; zero targets do not limit."""
    limits = [F.floor(F.col(counts)[i] / t) for i, t in enumerate(bounds.target) if t]
    copies = F.least(F.lit(window * bounds.block).cast("long"), *limits)
    rest = F.array(*[F.col(counts)[i] - copies * t for i, t in enumerate(bounds.target)])
    return [copies.alias("pattern_copies"), rest.alias("remainders")]

"""Fairness of blocks and windows over a positioned stream."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenflow.operators.bounds import Bounds
from evenflow.operators.order import OrderedStream, int_div, null_safe_join, running_totals, with_stream_length
from evenflow.operators.quantiles import exact_quantiles
from evenflow.operators.sketch import backward_sketch, count_names, indicators, sliding_counts


def check_window(window: int, block: int) -> int:
    """Blocks per window."""
    if block < 1 or window < block or window % block:
        raise ValueError(f"block size {block} must divide window size {window}")
    return window // block


def tumbling_blocks(stream: OrderedStream, attr: str, bounds: Bounds) -> DataFrame:
    """Aligned blocks: counts and verdict; an incomplete last block is dropped."""
    names = count_names(bounds)
    block = int_div(stream.pos, bounds.block).alias("block")
    counted = stream.df.groupBy(*stream.keys, block).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(mark).alias(name) for name, mark in zip(names, indicators(attr, bounds), strict=True)],
    )
    return counted.where(F.col("_n") == bounds.block).select(
        *stream.keys, "block", *names, bounds.block_is_fair([F.col(n) for n in names]).alias("is_fair")
    )


def block_deficits(stream: OrderedStream, attr: str, bounds: Bounds) -> DataFrame:
    """Missing items per category and in total for every aligned block."""
    names = count_names(bounds)
    missing = bounds.deficits([F.col(n) for n in names])
    return tumbling_blocks(stream, attr, bounds).select(
        *stream.keys, "block",
        *[m.alias(name) for m, name in zip(missing, count_names(bounds, "d"), strict=True)],
        reduce(lambda a, b: a + b, missing).alias("deficit"),
    )


def remaining_deficit(stream: OrderedStream, attr: str, bounds: Bounds) -> DataFrame:
    """Total shortage of this aligned block and all later ones of its stream."""
    per_block = block_deficits(stream, attr, bounds).select(*stream.keys, "block", "deficit")
    blocks = replace(stream, df=per_block, pos="block")
    before = running_totals(blocks, {"_before": F.col("deficit")}, inclusive=False)
    total = per_block.groupBy(*stream.keys).agg(F.sum("deficit").alias("_total"))
    joined = (
        null_safe_join(before, total, stream.keys) if stream.keys else before.crossJoin(F.broadcast(total))
    )
    return joined.select(
        *stream.keys, "block", "deficit", (F.col("_total") - F.col("_before")).alias("remaining_deficit")
    )


def first_unfair_block(stream: OrderedStream, attr: str, bounds: Bounds) -> DataFrame:
    """Start of the first unfair aligned block per stream (null when all are fair)."""
    blocks = tumbling_blocks(stream, attr, bounds)
    start = F.when(~F.col("is_fair"), F.col("block") * bounds.block)
    return blocks.groupBy(*stream.keys).agg(F.min(start).alias("first_unfair_start"))


def sliding_blocks(stream: OrderedStream, attr: str, bounds: Bounds) -> DataFrame:
    """Every block of s consecutive rows: (block_start, counts, is_fair)."""
    s = bounds.block
    rows, _, owned = sliding_counts(stream, attr, bounds, halo=s - 1)
    names = count_names(bounds)
    return rows.where(owned & (F.col(stream.pos) >= s - 1)).select(
        *stream.keys,
        (F.col(stream.pos) - (s - 1)).alias("block_start"),
        *names,
        bounds.block_is_fair([F.col(n) for n in names]).alias("is_fair"),
    )


def sliding_fair_count(stream: OrderedStream, attr: str, bounds: Bounds) -> DataFrame:
    """The repair objective: fair blocks among all sliding blocks of a stream."""
    return sliding_blocks(stream, attr, bounds).groupBy(*stream.keys).agg(
        F.count(F.lit(1)).alias("sliding_blocks"), F.count_if("is_fair").alias("fair_blocks")
    )


def window_monitor(stream: OrderedStream, attr: str, bounds: Bounds, window: int) -> DataFrame:
    """Every window of W consecutive rows (slide 1): fair aligned blocks in it and whether all are fair."""
    blocks = check_window(window, bounds.block)
    rows, strided, owned = sliding_counts(stream, attr, bounds, halo=window - 1)
    counts = [F.col(n) for n in count_names(bounds)]
    verdict = rows.withColumn("_fair", bounds.block_is_fair(counts).cast("int"))
    last_blocks = F.sum("_fair").over(strided.rowsBetween(-(blocks - 1), 0))
    return (
        verdict.withColumn("fair_blocks", last_blocks)
        .where(owned & (F.col(stream.pos) >= window - 1))
        .select(
            *stream.keys,
            (F.col(stream.pos) - (window - 2)).alias("window_number"),
            "fair_blocks",
            (F.col("fair_blocks") == blocks).alias("is_fair"),
        )
    )


def window_updates(stream: OrderedStream, attr: str, bounds: Bounds, window: int, max_windows: int | None = None,
                   ) -> DataFrame:
    """One nested record per window: verdict, items, block size and running metrics.

    The item list repeats W labels per row, so this is for watching a stream, not for bulk analysis.
    """
    blocks = check_window(window, bounds.block)
    running = monitor_running(stream, attr, bounds, window)
    rows, parts, owned = stream.tiles(window - 1)
    back = Window.partitionBy(*parts).orderBy(stream.pos).rowsBetween(-(window - 1), 0)
    items = (
        rows.withColumn("window_items", F.collect_list(F.col(attr).cast("string")).over(back))
        .where(owned & (F.col(stream.pos) >= window - 1))
        .select(*stream.keys, (F.col(stream.pos) - (window - 2)).alias("window_number"), "window_items")
    )
    if max_windows is not None:
        items = items.where(F.col("window_number") <= max_windows)
    return null_safe_join(running, items, [*stream.keys, "window_number"]).select(
        *stream.keys, "window_number", "is_fair",
        F.when(F.col("is_fair"), "Window is fair").otherwise("Window is not fair").alias("fair_text"),
        F.struct(
            F.lit(window).alias("window_size"), F.lit(bounds.block).alias("block_size"),
            F.col("window_number").alias("windows_covered"),
            F.col("fair_so_far").alias("fair_blocks"),
            (F.col("window_number") * blocks).alias("total_blocks"),
            F.round("pct_so_far", 2).alias("fair_block_pct"),
        ).alias("metrics"),
        "window_items", F.lit(bounds.block).alias("block_size"), F.lit(attr).alias("attribute"),
    )


def monitor_running(stream: OrderedStream, attr: str, bounds: Bounds, window: int) -> DataFrame:
    """The monitor with its metrics after each window."""
    blocks = check_window(window, bounds.block)
    seen = replace(stream, df=window_monitor(stream, attr, bounds, window), pos="window_number")
    return running_totals(seen, {"fair_so_far": F.col("fair_blocks")}).withColumn(
        "pct_so_far", F.col("fair_so_far") * 100 / (F.col("window_number") * blocks)
    )


def monitor_summary(stream: OrderedStream, attr: str, bounds: Bounds, window: int,
                    max_windows: int | None = None) -> DataFrame:
    """Windows, blocks, fair blocks and percentages per stream; ``max_windows`` stops as a bounded run would."""
    seen = window_monitor(stream, attr, bounds, window)
    if max_windows is not None:
        seen = seen.where(F.col("window_number") <= max_windows)
    return summarize_windows(seen, list(stream.keys), check_window(window, bounds.block))


def monitor_summaries(stream: OrderedStream, attr: str, cases: Mapping[str, tuple[Bounds, int]],
                      max_windows: int | None = None) -> DataFrame:
    """``monitor_summary`` of several (bounds, window) cases that share categories and block size.

    Blocks are counted once; every case adds only a verdict and one strided sum, and all of them are summed up
    in the same aggregate. Columns: keys, ``case``, and the summary.
    """
    some = next(iter(cases.values()))[0]
    if any((b.block, b.categories) != (some.block, some.categories) for b, _ in cases.values()):
        raise ValueError("cases must share categories and block size")
    widest = max(window for _, window in cases.values())
    rows, strided, owned = sliding_counts(stream, attr, some, halo=widest - 1)
    counts = [F.col(n) for n in count_names(some)]
    verdicts = rows.withColumns({
        f"_v{i}": b.block_is_fair(counts).cast("int") for i, (b, _) in enumerate(cases.values())
    })
    summed = verdicts.withColumns({
        f"_f{i}": F.sum(f"_v{i}").over(strided.rowsBetween(1 - check_window(w, b.block), 0))
        for i, (b, w) in enumerate(cases.values())
    }).where(owned)
    sums = []
    for i, (b, w) in enumerate(cases.values()):
        seen = F.col(stream.pos) >= w - 1
        if max_windows is not None:
            seen = seen & (F.col(stream.pos) < w - 1 + max_windows)
        sums += [
            F.count_if(seen).alias(f"_n{i}"), F.sum(F.when(seen, F.col(f"_f{i}"))).alias(f"_s{i}"),
            F.count_if(seen & (F.col(f"_f{i}") == w // b.block)).alias(f"_w{i}"),
        ]
    totals = summed.groupBy(*stream.keys).agg(*sums)
    long = totals.select(*stream.keys, F.inline(F.array(*[
        F.struct(F.lit(name).alias("case"), F.lit(w // b.block).alias("_blocks"), F.col(f"_n{i}").alias("windows"),
                 F.col(f"_s{i}").alias("fair_blocks"), F.col(f"_w{i}").alias("fair_windows"))
        for i, (name, (b, w)) in enumerate(cases.items())
    ]))).where("windows > 0")
    return long.select(
        *stream.keys, "case", "windows", (F.col("windows") * F.col("_blocks")).alias("total_blocks"), "fair_blocks",
        (F.col("fair_blocks") * 100 / (F.col("windows") * F.col("_blocks"))).alias("pct_fair"),
        "fair_windows", (F.col("fair_windows") * 100 / F.col("windows")).alias("pct_fair_windows"),
    )


def summarize_windows(windows: DataFrame, by: list[str], blocks: int) -> DataFrame:
    totals = windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("fair_blocks").alias("fair_blocks"),
        F.count_if("is_fair").alias("fair_windows"),
    )
    return totals.select(
        *by, "windows", (F.col("windows") * blocks).alias("total_blocks"), "fair_blocks",
        (F.col("fair_blocks") * 100 / (F.col("windows") * blocks)).alias("pct_fair"),
        "fair_windows", (F.col("fair_windows") * 100 / F.col("windows")).alias("pct_fair_windows"),
    )


def hopping_windows(stream: OrderedStream, attr: str, bounds: Bounds, window: int, slide: int) -> DataFrame:
    """Windows that start at every ``slide``-th row."""
    return window_monitor(stream, attr, bounds, window).where((F.col("window_number") - 1) % slide == 0)


def hopping_summary(stream: OrderedStream, attr: str, bounds: Bounds, window: int, slide: int) -> DataFrame:
    """Fair hopping windows, and fair blocks with every distinct covered block counted once.

    Whether some hopping window covers the block at b is arithmetic: one of the starts b - j*s must be a
    multiple of the slide and leave room for a whole window. No block is expanded or de-duplicated.
    """
    blocks, s = check_window(window, bounds.block), bounds.block
    covered = reduce(
        lambda a, b: a | b,
        [
            (start >= 0) & (start % slide == 0) & (start + window <= F.col("n_rows"))
            for start in (F.col("block_start") - j * s for j in range(blocks))
        ],
    )
    rows, strided, owned = sliding_counts(stream, attr, bounds, halo=window - 1)
    fair = bounds.block_is_fair([F.col(n) for n in count_names(bounds)])
    seen = (
        rows.withColumn("_fair", fair)
        .withColumn("_fair_blocks", F.sum(F.col("_fair").cast("int")).over(strided.rowsBetween(-(blocks - 1), 0)))
        .where(owned & (F.col(stream.pos) >= s - 1))
        .select(*stream.keys, stream.pos, (F.col(stream.pos) - (s - 1)).alias("block_start"), "_fair", "_fair_blocks")
    )
    first = F.col(stream.pos) - (window - 1)
    whole = (first >= 0) & (first % slide == 0)
    return with_stream_length(stream, seen).groupBy(*stream.keys).agg(
        F.count_if(whole).alias("windows"), F.count_if(whole & (F.col("_fair_blocks") == blocks)).alias("fair_windows"),
        F.count_if(covered).alias("distinct_blocks"), F.count_if(covered & F.col("_fair")).alias("fair_distinct_blocks"),
    ).where("windows > 0")


def backward_blocks(stream: OrderedStream, attr: str, bounds: Bounds) -> DataFrame:
    """Aligned blocks verified from suffix counts, floors only; equals the tumbling verdict in floor mode.

    Suffix counts at block starts telescope: each start adds to its own block and is taken off the one before,
    so a partial aggregate does the differencing and nothing is sorted.
    """
    s, names = bounds.block, count_names(bounds, "b")
    starts = backward_sketch(stream, attr, bounds).where(F.col(stream.pos) % s == 0)
    own = int_div(stream.pos, s)
    halves = starts.select(*stream.keys, *names, F.explode(F.array(
        F.struct(own.alias("block"), F.lit(1).alias("sign")),
        F.struct((own - 1).alias("block"), F.lit(-1).alias("sign")),
    )).alias("_half"))
    counted = halves.groupBy(*stream.keys, F.col("_half.block").alias("block")).agg(
        *[F.sum(F.col(n) * F.col("_half.sign")).alias(n) for n in names]
    )
    complete = with_stream_length(stream, counted).where(
        (F.col("block") >= 0) & ((F.col("block") + 1) * s <= F.col("n_rows"))
    )
    return complete.select(
        *stream.keys, "block", bounds.floor_only().block_is_fair([F.col(n) for n in names]).alias("is_fair")
    )


def latency_report(df: DataFrame, by: list[str], latency: str, windows_per_call: int) -> DataFrame:
    """Mean and exact 90th-percentile latency, and windows per second = windows per call / mean latency."""
    means = df.groupBy(*by).agg(F.count(latency).alias("calls"), F.avg(latency).alias("mean_ms"))
    tail = exact_quantiles(df, by, latency, [(9, 10)]).select(*by, F.col("quantiles")[0].alias("p90_ms"))
    joined = null_safe_join(means, tail, by) if by else means.crossJoin(F.broadcast(tail))  # one row per side
    return joined.withColumn("windows_per_second", F.lit(windows_per_call) * (F.lit(1000) / F.col("mean_ms")))


def chunk_scores(chunks: DataFrame, by: list[str], attr: str, bounds: Bounds, window: int,
                 place: str = "position_in_chunk") -> DataFrame:
    """Score every chunk over its X+1 sliding windows; ``by`` names one chunk of one strategy.

    Chunks are at most W+X rows, so each is its own small stream.
    """
    stream = OrderedStream(chunks.withColumn(place, F.col(place).cast("long")), tuple(by), place)
    return summarize_windows(
        window_monitor(stream, attr, bounds, window), by, check_window(window, bounds.block)
    )


def score_totals(scores: DataFrame, by: list[str]) -> DataFrame:
    """Chunk scores summed over all chunks of a strategy or run."""
    totals = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"), *[F.sum(c).alias(c) for c in
                                             ("windows", "total_blocks", "fair_blocks", "fair_windows")]
    )
    return totals.withColumns({
        "pct_fair": F.col("fair_blocks") * 100 / F.col("total_blocks"),
        "pct_fair_windows": F.col("fair_windows") * 100 / F.col("windows"),
    })

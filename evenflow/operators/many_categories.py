"""Monitoring by an attribute with very many categories, such as an id.

The dense monitor carries one count column per category. Here nothing grows with the number of categories: a row is
two events, it enters the sliding block at its own position and leaves it one block later. Inside a tile the events
of one category give its count in the block; whenever that count crosses a bound, the number of broken bounds of the
block changes by one. A block is fair where no bound is broken.

Bounds need no table of all categories either. A category with less than one expected place in a block has floor 0
and ceiling 1; those with a whole place or more are at most ``block`` many, so they alone are listed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenflow.operators.monitor import check_window
from evenflow.operators.order import OrderedStream, int_div


@dataclass(frozen=True)
class SparseBounds:
    """(floor, ceiling) of the listed categories, at most two per place of a block; every other one has ``other``.

    A category that the fitted table did not have is bounded as the rarest ones are.
    """

    block: int
    listed: Mapping[str, tuple[int, int]]
    other: tuple[int, int] = (0, 1)

    def floor_only(self) -> SparseBounds:
        """Same floors with the ceilings lifted to the block size."""
        lifted = {c: (low, self.block) for c, (low, _) in self.listed.items() if low}
        return replace(self, listed=lifted, other=(0, self.block))

    @property
    def needed(self) -> int:
        """Categories that every fair block holds."""
        return sum(low > 0 for low, _ in self.listed.values())

    @property
    def places(self) -> int:
        """Places of a block that the floors take."""
        return sum(low for low, _ in self.listed.values())

    def attach(self, df: DataFrame, category: str) -> DataFrame:
        """Add ``_low`` and ``_high``; the broadcast table has one row per listed category."""
        rows = [(c, low, high) for c, (low, high) in self.listed.items()]
        table = df.sparkSession.createDataFrame(rows, "_listed string, _low long, _high long")
        joined = df.join(F.broadcast(table), F.col(category) == F.col("_listed"), "left").drop("_listed")
        return joined.withColumns({
            "_low": F.coalesce("_low", F.lit(self.other[0]).cast("long")),
            "_high": F.coalesce("_high", F.lit(self.other[1]).cast("long")),
        })


def fit_sparse_bounds(df: DataFrame, attr: str, block: int, target: bool = False) -> SparseBounds:
    """Bounds from the real distribution of ``attr``; null values have none.

    Only categories with a whole place come to the driver. ``target`` checks the apportioned target as a minimum
    without a ceiling; the spare places go to the largest remainders, at most ``block`` further categories.
    """
    counts = df.where(F.col(attr).isNotNull()).groupBy(attr).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return SparseBounds(block, {})
    placed = counts.select(
        F.col(attr).alias("_value"), F.col(attr).cast("string").alias("category"),
        F.expr(f"n * {block}L div {total}L").alias("low"), F.expr(f"n * {block}L % {total}L").alias("rest"),
    )
    whole = {r.category: (r.low, r.low + (r.rest > 0)) for r in placed.where("low > 0").collect()}
    bounds = SparseBounds(block, whole)
    if not target:
        return bounds
    spare = block - bounds.places
    extra = {r.category for r in placed.orderBy(F.desc("rest"), F.asc("_value")).limit(spare).collect()}
    floors = {c: whole.get(c, (0, 0))[0] + (c in extra) for c in {*whole, *extra}}
    return SparseBounds(block, {c: (low, block) for c, low in floors.items()}, (0, block))


def _broken(count: Column, low: str = "_low", high: str = "_high") -> Column:
    """Is the bound broken at this count, relative to a block without the category at all."""
    return ((count < F.col(low)) | (count > F.col(high))).cast("long") - (F.col(low) > 0).cast("long")


def _broken_bounds(stream: OrderedStream, attr: str, bounds: SparseBounds, halo: int):
    """(rows with ``_broken`` bounds of the block that ends there, partition columns); halo rows are not ``_owned``."""
    rows, parts, owned = stream.tiles(halo)
    narrow = rows.select(*parts, F.col(stream.pos).alias("_end"), F.col(attr).cast("string").alias("_category"),
                         owned.alias("_owned"))
    place = F.col("_category").isNotNull().cast("long")
    events = bounds.attach(narrow, "_category").select(*parts, "_category", "_low", "_high", F.inline(F.array(
        F.struct(F.col("_end").alias("_at"), place.alias("_step"), F.lit(True).alias("_row"), F.col("_owned").alias("_own")),
        F.struct((F.col("_end") + bounds.block).alias("_at"), (-place).alias("_step"), F.lit(False).alias("_row"),
                 F.lit(False).alias("_own")),
    )))
    # A tile holds a bounded number of events, and so does a category in it. Where a row enters as another of its
    # category leaves, both changes are at one position and cancel in the sum over it.
    along = Window.partitionBy(*parts, "_category").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("_count", F.sum("_step").over(along))
    changed = counted.select(
        *parts, "_at", "_row", "_own",
        (_broken(F.col("_count")) - _broken(F.col("_count") - F.col("_step"))).alias("_change"),
    )
    # The exchange is by tile, so the running sum and the strided one after it share it.
    up_to = Window.partitionBy(*parts).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    summed = changed.withColumn("_broken", F.sum("_change").over(up_to) + F.lit(bounds.needed))
    return summed.where("_row").select(*parts, F.col("_at").alias(stream.pos), "_broken", F.col("_own").alias("_owned")), parts


def sparse_sliding_blocks(stream: OrderedStream, attr: str, bounds: SparseBounds) -> DataFrame:
    """Every block of s consecutive rows: (keys, block_start, broken_bounds, is_fair)."""
    s = bounds.block
    rows, _ = _broken_bounds(stream, attr, bounds, halo=s - 1)
    return rows.where(F.col("_owned") & (F.col(stream.pos) >= s - 1)).select(
        *stream.keys, (F.col(stream.pos) - (s - 1)).alias("block_start"), F.col("_broken").alias("broken_bounds"),
        (F.col("_broken") == 0).alias("is_fair"),
    )


def sparse_window_monitor(stream: OrderedStream, attr: str, bounds: SparseBounds, window: int) -> DataFrame:
    """``window_monitor`` for any number of categories: (keys, window_number, fair_blocks, is_fair)."""
    s, blocks = bounds.block, check_window(window, bounds.block)
    rows, parts = _broken_bounds(stream, attr, bounds, halo=window - 1)
    strided = Window.partitionBy(*parts).orderBy("_residue", stream.pos).rowsBetween(-(blocks - 1), 0)
    fair = rows.withColumn("_residue", F.col(stream.pos) % F.lit(s)).withColumn(
        "fair_blocks", F.sum((F.col("_broken") == 0).cast("int")).over(strided))
    return fair.where(F.col("_owned") & (F.col(stream.pos) >= window - 1)).select(
        *stream.keys, (F.col(stream.pos) - (window - 2)).alias("window_number"), "fair_blocks",
        (F.col("fair_blocks") == blocks).alias("is_fair"),
    )


def sparse_tumbling_blocks(stream: OrderedStream, attr: str, bounds: SparseBounds) -> DataFrame:
    """Aligned whole blocks: (keys, block, deficit, excess, is_fair), items missing below floors and beyond ceilings."""
    s = bounds.block
    named = stream.df.select(*stream.keys, int_div(stream.pos, s).alias("block"),
                             F.col(attr).cast("string").alias("_category"))
    counted = bounds.attach(
        named.groupBy(*stream.keys, "block", "_category").agg(F.count(F.lit(1)).alias("_n")), "_category")
    real = F.col("_category").isNotNull()
    summed = counted.groupBy(*stream.keys, "block").agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.when(real, F.least("_n", "_low")).otherwise(0)).alias("_met"),
        F.sum(F.when(real, F.greatest(F.col("_n") - F.col("_high"), F.lit(0))).otherwise(0)).alias("excess"),
    )
    return summed.where(F.col("_rows") == s).select(
        *stream.keys, "block", (F.lit(bounds.places) - F.col("_met")).alias("deficit"), "excess",
        ((F.col("_met") == bounds.places) & (F.col("excess") == 0)).alias("is_fair"),
    )

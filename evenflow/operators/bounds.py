"""Per-category bounds of a block: distribution, floor/ceiling, apportioned targets.

The integer forms use exact (n, N) counts: ``floor = n*s div N``, never a float product, so a proportion such
as 0.07 cannot drift over an integer. Float mode is kept for proportions a user writes down.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, attr: str) -> DataFrame:
    """(category, gidx, n, total, percentage) over the non-null values; one row per category, natural order."""
    counts = df.where(F.col(attr).isNotNull()).groupBy(attr).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # runs on one row per category, never on data rows
    return counts.select(
        F.col(attr).cast("string").alias("category"),
        (F.row_number().over(Window.orderBy(attr)) - 1).alias("gidx"),
        "n",
        F.sum("n").over(whole).alias("total"),
        (F.col("n") / F.sum("n").over(whole)).alias("percentage"),
    )


def bounds_table(df: DataFrame, attr: str, block: int) -> DataFrame:
    """Derivation table: (category, percentage, reorder_target, floor, ceiling) for one block size."""
    base = distribution(df, attr).select(
        "category", "gidx", "percentage",
        F.expr(f"n * {block}L div total").alias("floor"),
        F.expr(f"n * {block}L % total").alias("rest"),
    )
    by_rest = Window.orderBy(F.desc("rest"), F.asc("gidx"))
    spare = F.lit(block) - F.sum("floor").over(Window.partitionBy())
    return base.select(
        "category",
        "percentage",
        (F.col("floor") + (F.row_number().over(by_rest) <= spare).cast("long")).alias("reorder_target"),
        "floor",
        (F.col("floor") + (F.col("rest") > 0).cast("long")).alias("ceiling"),
    )


@dataclass(frozen=True)
class Bounds:
    """Bounds of one attribute for one block size, in category order (the order of all label indices)."""

    categories: tuple[str, ...]
    block: int
    floor: tuple[int, ...]
    ceiling: tuple[int, ...]
    target: tuple[int, ...]

    @classmethod
    def from_counts(cls, counts: Mapping[str, int], block: int) -> Bounds:
        """Exact bounds from category counts; the mapping's order fixes the category order."""
        total = sum(counts.values())
        floor, rest = zip(*(divmod(n * block, total) for n in counts.values()), strict=True)
        ceiling = [f + (r > 0) for f, r in zip(floor, rest, strict=True)]
        return cls(tuple(counts), block, tuple(floor), tuple(ceiling), _largest_remainder(floor, rest, block))

    @classmethod
    def from_proportions(cls, proportions: Mapping[str, float], block: int) -> Bounds:
        """Float mode, for proportions given by a user; they must sum to one."""
        if abs(sum(proportions.values()) - 1.0) > 1e-6:
            raise ValueError("proportions must sum to 1")
        raw = [p * block for p in proportions.values()]
        floor = [math.floor(r) for r in raw]
        rest = [r - f for r, f in zip(raw, floor, strict=True)]
        return cls(
            tuple(proportions), block, tuple(floor), tuple(math.ceil(r) for r in raw),
            _largest_remainder(floor, rest, block),
        )

    @classmethod
    def from_limits(
        cls,
        floor: Mapping[str, int],
        block: int,
        ceiling: Mapping[str, int] | None = None,
        target: Mapping[str, int] | None = None,
    ) -> Bounds:
        """Limits given directly. Without a ceiling only the floor is checked; the target defaults to the floor."""
        names = tuple(floor)
        return cls(
            names, block, tuple(floor.values()),
            tuple((ceiling or dict.fromkeys(names, block))[c] for c in names),
            tuple((target or floor)[c] for c in names),
        )

    def floor_only(self) -> Bounds:
        """Same floors with the ceiling lifted to the block size."""
        return Bounds(self.categories, self.block, self.floor, (self.block,) * len(self.floor), self.target)

    def target_as_floor(self) -> Bounds:
        """Check against the reorder target as a minimum, without a ceiling."""
        return Bounds(self.categories, self.block, self.target, (self.block,) * len(self.floor), self.target)

    def known(self, attr: str) -> Column:
        """Filter for rows whose category has bounds; apply it before positions are given."""
        return F.col(attr).cast("string").isin(*self.categories)

    def label_index(self, attr: str) -> Column:
        """Index of the row's category; one without bounds raises."""
        text = F.col(attr).cast("string")
        index = F.array_position(F.array(*[F.lit(c) for c in self.categories]), text).cast("int") - 1
        return F.when(index >= 0, index).otherwise(
            F.raise_error(F.concat(F.lit("category not in the bounds: "), F.coalesce(text, F.lit("null"))))
        )

    def block_is_fair(self, counts: Sequence[Column]) -> Column:
        """Two-sided predicate over the per-category counts of a block."""
        verdict = F.lit(True)
        for count, low, high in zip(counts, self.floor, self.ceiling, strict=True):
            verdict = verdict & (count >= low)
            if high < self.block:
                verdict = verdict & (count <= high)
        return verdict

    def deficits(self, counts: Sequence[Column]) -> list[Column]:
        """Missing items per category, never negative."""
        return [
            F.greatest(F.lit(low).cast("long") - count, F.lit(0).cast("long"))
            for count, low in zip(counts, self.floor, strict=True)
        ]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The bounds as a dimension table (one row per category)."""
        rows = list(zip(self.categories, range(len(self.floor)), self.target, self.floor, self.ceiling, strict=True))
        return spark.createDataFrame(rows, "category string, gidx int, target int, floor int, ceiling int")


def _largest_remainder(floor: Sequence[int], rest: Sequence[float], block: int) -> tuple[int, ...]:
    spare = block - sum(floor)
    winners = set(sorted(range(len(floor)), key=lambda i: (-rest[i], i))[:spare])
    return tuple(f + (i in winners) for i, f in enumerate(floor))


#: Categories that a dense monitor carries at most, one count column each; see ``many_categories`` beyond that.
MOST_CATEGORIES = 1024


def fit_bounds(df: DataFrame, attr: str, block: int, places: int | None = None) -> Bounds:
    """Bounds from the real distribution of ``attr``: one aggregate, one row per category back.

    Monitoring allows more categories than a block has places; the planners do not (``check_places``). An attribute
    with more than ``places`` categories is refused: ``many_categories`` monitors those without a list of them.
    """
    return Bounds.from_counts(category_counts(df, attr, places), block)


def check_places(bounds: Bounds) -> None:
    """A repaired block must have a place for every category."""
    if bounds.block < len(bounds.categories):
        raise ValueError(f"block size {bounds.block} is below the {len(bounds.categories)} categories")


def category_counts(df: DataFrame, attr: str, places: int | None = None) -> dict[str, int]:
    """Counts per category in natural category order, one row per category on the driver.

    At most one row more than ``places`` is fetched (``MOST_CATEGORIES`` unless given); if it is there, the attribute
    is refused.
    """
    places = MOST_CATEGORIES if places is None else places
    grouped = df.where(F.col(attr).isNotNull()).groupBy(attr).agg(F.count(F.lit(1)).alias("n"))
    named = grouped.orderBy(attr).limit(places + 1).select(F.col(attr).cast("string").alias("category"), "n")
    counted = named.collect()
    if len(counted) > places:
        raise ValueError(f"{attr} has more than {places} categories; use many_categories")
    return {row.category: row.n for row in counted}

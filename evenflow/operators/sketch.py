"""Prefix and suffix count sketches, and block counts as prefix differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evenflow.operators.bounds import Bounds
from evenflow.operators.order import OrderedStream, null_safe_join, running_totals


def indicators(attr: str, bounds: Bounds) -> list[Column]:
    """One 0/1 column expression per category."""
    text = F.col(attr).cast("string")
    return [F.coalesce((text == F.lit(c)).cast("long"), F.lit(0).cast("long")) for c in bounds.categories]


def count_names(bounds: Bounds, prefix: str = "c") -> list[str]:
    return [f"{prefix}{i}" for i in range(len(bounds.categories))]


def forward_sketch(stream: OrderedStream, attr: str, bounds: Bounds, prefix: str = "p") -> DataFrame:
    """Counts per category of all rows up to and including this one, per stream key."""
    names = count_names(bounds, prefix)
    return running_totals(stream, dict(zip(names, indicators(attr, bounds), strict=True)))


def backward_sketch(stream: OrderedStream, attr: str, bounds: Bounds, prefix: str = "b") -> DataFrame:
    """Counts per category from this row to the end of its stream: total - rows before this one."""
    names, marks = count_names(bounds, prefix), indicators(attr, bounds)
    before = running_totals(stream, dict(zip(names, marks, strict=True)), inclusive=False)
    totals = stream.df.groupBy(*stream.keys).agg(
        *[F.sum(mark).alias(f"_all_{name}") for name, mark in zip(names, marks, strict=True)]
    )
    if stream.keys:
        joined = null_safe_join(before, totals, stream.keys)
    else:
        joined = before.crossJoin(F.broadcast(totals))  # a key-less stream has exactly one totals row
    return joined.select(*stream.df.columns, *[(F.col(f"_all_{n}") - F.col(n)).alias(n) for n in names])


def sliding_counts(
    stream: OrderedStream, attr: str, bounds: Bounds, halo: int
) -> tuple[DataFrame, WindowSpec, Column]:
    """(rows with counts c0..cL of the block that ends there, strided window, is-owned).

    No O(block) frame: a block ending at e holds ``P(e) - P(e - s)``, and e - s is the row just before e when
    a tile is sorted by (pos mod s, pos). The same order makes every s-th row adjacent, which is how windows
    add up their blocks. The rows still carry their halo.
    """
    rows, parts, owned = stream.tiles(halo)
    along = Window.partitionBy(*parts).orderBy(stream.pos).rowsBetween(Window.unboundedPreceding, 0)
    prefix, counts = count_names(bounds, "_p"), count_names(bounds)
    summed = rows.select(
        "*", (F.col(stream.pos) % F.lit(bounds.block)).alias("_residue"),
        *[F.sum(mark).over(along).alias(p) for p, mark in zip(prefix, indicators(attr, bounds), strict=True)],
    )
    strided = Window.partitionBy(*parts).orderBy("_residue", stream.pos)
    before = summed.withColumns({
        "_same": F.coalesce(F.lag("_residue", 1).over(strided) == F.col("_residue"), F.lit(False)),
        **{f"{p}_lag": F.lag(p, 1).over(strided) for p in prefix},
    })
    counted = before.withColumns({
        c: F.col(p) - F.when(F.col("_same"), F.col(f"{p}_lag")).otherwise(0)
        for c, p in zip(counts, prefix, strict=True)
    })
    return counted.drop("_same", *prefix, *[f"{p}_lag" for p in prefix]), strided, owned

"""Total order of a stream: dense positions, halo tiles and running totals.

Spark has no implicit row order, so every order-dependent operator works on an ``OrderedStream``: rows
with a 0-based dense position inside each stream key. Two ways lead there:

* ``range``   -- the default at every size: rows are range-partitioned on (keys, order), so a key that holds most
  of the table is spread over many tasks; local ranks plus per-partition offsets give the position. The ranked
  rows are written once, so that ranks and offsets come from the same partitioning even after a lost executor.
* ``window``  -- one ``row_number`` per key, for a caller who knows that every key is small.

Operators that look back over rows (blocks, windows) never sort a whole key: positions are cut into tiles,
and each tile is given a halo of the rows just before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenflow.session import materialize

#: Rows of a tile (the halo comes on top). Small enough that tiles spread evenly over the tasks.
TILE_ROWS = 1 << 15

#: Rows that a task sorts on average. A stream beyond that gets as many tasks as it takes, whatever the session's
#: number and size of partitions are, so the memory of a task does not grow with the stream.
TASK_ROWS = 1 << 18

#: Up to so many partitions (``spark.shuffle.sort.bypassMergeThreshold``) a task writes what it shuffles straight to
#: files; into more partitions it first holds all of it in memory.
DIRECT_PARTITIONS = 200


def int_div(column: str, divisor: int) -> Column:
    """Integer division of a non-negative column."""
    return F.expr(f"`{column}` div {divisor}")


def task_count(spark: SparkSession, rows: int) -> int | None:
    """Tasks for a stream of so many rows; None leaves a short one to Spark."""
    return None if rows <= TASK_ROWS else max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class OrderedStream:
    """Rows with a dense position. ``tile_rows`` is None when the caller vouches that every key fits one task.

    ``tasks`` is the number of tasks that share the tiles; None leaves it to Spark.
    """

    df: DataFrame
    keys: tuple[str, ...]
    pos: str = "pos"
    tile_rows: int | None = None
    tasks: int | None = None

    def with_df(self, df: DataFrame) -> OrderedStream:
        return replace(self, df=df)

    def tiles(self, halo: int) -> tuple[DataFrame, list[str], Column]:
        """(rows, partition columns, is-owned). Rows in a halo are repeated in the next tile, not owned by it."""
        if self.tile_rows is None:
            return self.df, list(self.keys), F.lit(True)
        home = int_div(self.pos, self.tile_rows)
        last = F.expr(f"(`{self.pos}` + {halo}) div {self.tile_rows}")
        spread = self.df.withColumn("_tile", F.explode(F.sequence(home, last)))
        parts = [*self.keys, "_tile"]
        return self.dealt(spread, parts), parts, home == F.col("_tile")

    def dealt(self, tiled: DataFrame, parts: Sequence[str]) -> DataFrame:
        """One exchange by tile, into ``tasks`` partitions, that all windows of a tile share."""
        return tiled if self.tasks is None else tiled.repartition(self.tasks, *parts)


def ordered_stream(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    how: str = "range",
    tile_rows: int = TILE_ROWS,
    pos: str = "pos",
    rows: int | None = None,
) -> OrderedStream:
    """Give every row its dense position within ``keys``; ``order_by`` must be unique inside a key.

    Pass only the columns that the operators need: a large stream is written once, with all its columns. ``rows`` is
    the number of rows where the caller knows it; otherwise they are counted.
    """
    keys = tuple(keys)
    if how == "window":
        if not keys:
            raise ValueError("a stream without keys is one key of any size: order it by range")
        frame = Window.partitionBy(*keys).orderBy(*order_by)
        ranked = df.withColumn(pos, F.row_number().over(frame).cast("long") - 1)
        return OrderedStream(ranked, keys, pos)
    if how != "range":
        raise ValueError(f"unknown ordering method {how!r}")
    tasks = task_count(df.sparkSession, df.count() if rows is None else rows)
    return OrderedStream(_range_positions(df, keys, order_by, pos, tasks), keys, pos, tile_rows, tasks)


def _range_positions(df: DataFrame, keys: tuple[str, ...], order_by: Sequence[str], pos: str, tasks: int | None) -> DataFrame:
    by = [*keys, *order_by]
    seats = materialize(
        (df.repartitionByRange(*by) if tasks is None else df.repartitionByRange(tasks, *by))
        .sortWithinPartitions(*by)
        .withColumn("_seat", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seat", 33))
    )
    stretch = seats.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seat").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretch_key = F.struct(*keys, "_part").alias("_stretch")  # equal structs may hold nulls
    offsets = stretch.select(
        stretch_key, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    rows = seats.select("*", stretch_key)
    if tasks is not None:  # else adaptive execution may join millions of rows in a task, which then shuffles them all
        rows = rows.repartition(min(tasks, DIRECT_PARTITIONS), "_stretch")
    return (
        rows.join(offsets, "_stretch")
        .withColumn(pos, F.col("_seat") - F.col("_first") + F.col("_before"))
        .drop("_stretch", "_seat", "_part", "_first", "_before")
    )


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hash partitioning that keeps the configured number of partitions.

    For CPU-bound Python steps over small rows: sizing partitions by bytes would leave them to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys and keeps the left key columns once."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def running_totals(stream: OrderedStream, totals: Mapping[str, Column], inclusive: bool = True) -> DataFrame:
    """Running sums over each key in position order, without one task ever holding a key.

    Sums run inside tiles; the tile sums (one short row per tile) are accumulated and added back.
    """
    end = Window.currentRow if inclusive else -1
    if stream.tile_rows is None:
        frame = Window.partitionBy(*stream.keys).orderBy(stream.pos).rowsBetween(Window.unboundedPreceding, end)
        return stream.df.select("*", *[
            F.coalesce(F.sum(expr).over(frame), F.lit(0)).alias(name) for name, expr in totals.items()
        ])
    parts = [*stream.keys, "_tile"]
    tiled = stream.dealt(stream.df.withColumn("_tile", int_div(stream.pos, stream.tile_rows)), parts)
    local = Window.partitionBy(*parts).orderBy(stream.pos).rowsBetween(Window.unboundedPreceding, end)
    rows = tiled.select("*", *[
        F.coalesce(F.sum(expr).over(local), F.lit(0)).alias(name) for name, expr in totals.items()
    ])
    sums = tiled.groupBy(*parts).agg(*[F.sum(expr).alias(f"_t_{name}") for name, expr in totals.items()])
    earlier = Window.partitionBy(*stream.keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*parts, *[
        F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in totals
    ])
    joined = null_safe_join(rows, offsets, parts)
    return joined.select(*stream.df.columns, *[
        (F.col(name) + F.col(f"_o_{name}")).alias(name) for name in totals
    ])


def stream_lengths(stream: OrderedStream, name: str = "n_rows") -> DataFrame:
    """Rows per stream key."""
    return stream.df.groupBy(*stream.keys).agg(F.count(F.lit(1)).alias(name))


def with_stream_length(stream: OrderedStream, df: DataFrame, name: str = "n_rows") -> DataFrame:
    """Add the length of the row's own stream; a key-less stream has exactly one length row."""
    lengths = stream_lengths(stream, name)
    if not stream.keys:
        return df.crossJoin(F.broadcast(lengths))
    return null_safe_join(df, lengths, stream.keys)


def duplicate_order_keys(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Order keys that occur more than once in a stream; positions are only well defined if this is empty."""
    return df.groupBy(*keys, *order_by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def category_dictionary(df: DataFrame, attr: str) -> DataFrame:
    """Distinct categories in natural order with a dense index (one row per category)."""
    distinct = df.where(F.col(attr).isNotNull()).groupBy(attr).agg(F.count(F.lit(1)).alias("n"))
    return distinct.select(
        F.col(attr).cast("string").alias("category"),
        (F.row_number().over(Window.orderBy(attr)) - 1).alias("gidx"),
        "n",
    )

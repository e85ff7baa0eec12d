"""Preparation: filters, top-K collapse, crossed attributes, quantile binning, seeded shuffles, configurations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenflow.functions.columns import crossed, shuffle_key
from evenflow.operators.bounds import distribution
from evenflow.operators.order import OrderedStream, ordered_stream, task_count
from evenflow.operators.quantiles import count_values, quantiles_of_counts


def keep_members(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed."""
    return df.where(F.col(column).isin(*values))


def drop_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose value differs; a null is different from every value."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def collapse_to_top(df: DataFrame, column: str, k: int, out: str, other: str = "Other") -> DataFrame:
    """Keep the k most frequent values (ties to the smaller value), everything else becomes ``other``."""
    top = (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(column)).limit(k)
        .select(F.col(column).alias("_top"))
    )
    joined = df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left")  # k rows
    return joined.withColumn(out, F.coalesce(F.col("_top"), F.lit(other))).drop("_top")


def intersect(df: DataFrame, attributes: Sequence[str], out: str) -> DataFrame:
    """Add the crossed attribute."""
    return df.withColumn(out, crossed(attributes))


def intersectional_distribution(df: DataFrame, attributes: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Empirical joint distribution of the crossed attribute, from ``source`` if given, else from ``df``."""
    return distribution(intersect(df if source is None else source, attributes, "_cross"), "_cross")


def minute_clock(stream: OrderedStream, out: str, base: str = "2020-01-01 00:00:00") -> DataFrame:
    """A strictly increasing synthetic timestamp, one minute per row."""
    return stream.df.withColumn(out, F.expr(f"timestampadd(MINUTE, `{stream.pos}`, timestamp_ntz'{base}')"))


def seeded_runs(df: DataFrame, runs: int, row_id: Sequence[str], how: str = "range") -> OrderedStream:
    """The table once per run 1..runs, each in its own reproducible random order.

    The plain rows of a long stream are dealt to its tasks before they are repeated: a task that reads a large piece of
    the table would otherwise hold that piece ``runs`` times when it hands its rows on.
    """
    rows = df.count() * runs if how == "range" else None
    tasks = task_count(df.sparkSession, rows or 0)
    if tasks is not None:
        df = df.repartition(tasks, *row_id)
    numbers = df.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run_id"))
    repeated = df.crossJoin(F.broadcast(numbers)).withColumn("_shuffle", shuffle_key(F.col("run_id"), *row_id))
    return ordered_stream(repeated, ["run_id"], ["_shuffle", *row_id], how=how, rows=rows)


@dataclass(frozen=True)
class BinModel:
    """Right-closed quantile bins of a numeric column; the first bin includes its left edge."""

    column: str
    edges: tuple[float, ...]

    @property
    def size(self) -> int:
        return max(1, len(self.edges) - 1)

    def code(self) -> Column:
        """Bin number of a row (null stays null): how many interior edges lie below the value."""
        zero = F.when(F.col(self.column).isNotNull(), F.lit(0))
        return sum(((F.col(self.column) > edge).cast("int") for edge in self.edges[1:-1]), zero)

    def label(self, labels: Sequence[str]) -> Column:
        if len(labels) != self.size:
            raise ValueError(f"{len(labels)} labels for {self.size} bins of {self.column}: edges coincide")
        return F.element_at(F.array(*[F.lit(x) for x in labels]), self.code() + 1)

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        return df.withColumn(out or f"{self.column}_bin", self.code())


def fit_quantile_bins(df: DataFrame, column: str, bins: int) -> BinModel:
    """Fixed number of quantile bins; coinciding edges are merged."""
    return BinModel(column, _quantile_edges(count_values(df, [], column), column, [bins])[bins])


def fit_adaptive_bins(df: DataFrame, column: str, max_bins: int = 5, min_share: float = 0.15) -> BinModel:
    """The most bins (at most ``max_bins``) whose smallest non-empty bin still holds ``min_share`` of the rows.

    The data is read once, into counted values: all candidate edges come from one quantile pass over them, all
    bin sizes from one conditional sum.
    """
    counted = count_values(df, [], column)
    found = _quantile_edges(counted, column, range(1, max_bins + 1))
    models = {q: BinModel(column, edges) for q, edges in found.items() if len(edges) > 1}
    if not models:
        return BinModel(column, found[1] * 2)
    sizes = counted.agg(F.sum("n").alias("n"), *[
        F.sum(F.when(model.code() == i, F.col("n"))).alias(f"q{q}_{i}")
        for q, model in models.items() for i in range(model.size)
    ]).first()
    for q in sorted(models, reverse=True):
        filled = [sizes[f"q{q}_{i}"] for i in range(models[q].size) if sizes[f"q{q}_{i}"]]
        if min(filled) / sizes.n >= min_share:
            return models[q]
    raise AssertionError("one bin always holds everything")


def _quantile_edges(counted: DataFrame, column: str, sizes: Sequence[int]) -> dict[int, tuple[float, ...]]:
    fractions = sorted({(k, q) for q in sizes for k in range(q + 1)})
    row = quantiles_of_counts(counted, [], column, fractions).first()
    if row is None or row.quantiles[0] is None:
        raise ValueError(f"{column} has no values to bin")
    value = dict(zip(fractions, row.quantiles, strict=True))
    return {q: tuple(sorted({value[(k, q)] for k in range(q + 1)})) for q in sizes}


def bin_summary(df: DataFrame, model: BinModel) -> DataFrame:
    """(column, bin, range, count, percent) for every bin, empty ones included."""
    rows = [
        (i, f"{'[' if i == 0 else '('}{low:.2f}, {high:.2f}]")
        for i, (low, high) in enumerate(zip(model.edges, model.edges[1:], strict=False))
    ] or [(0, f"[{model.edges[0]:.2f}, {model.edges[0]:.2f}]")]
    ranges = df.sparkSession.createDataFrame(rows, "bin int, range string")
    counts = model.transform(df, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return (
        F.broadcast(ranges).join(counts, "bin", "left").crossJoin(F.broadcast(total))  # one row per bin; one total
        .select(
            F.lit(model.column).alias("column"), "bin", "range",
            F.coalesce("n", F.lit(0)).alias("count"),
            F.format_string("%.1f%%", F.coalesce("n", F.lit(0)) * 100 / F.col("total")).alias("percent"),
        )
    )


def valid_config(window: Column, block: Column, landmark: Column, categories: int | None = None,
                 whole_blocks: bool = True) -> Column:
    """Which (W, s, X) make sense; only the optimal strategy may drop ``whole_blocks``."""
    fine = (window % block == 0) & (landmark <= window)
    if whole_blocks:
        fine = fine & ((window + landmark) % block == 0)
    return fine if categories is None else fine & (block >= categories)

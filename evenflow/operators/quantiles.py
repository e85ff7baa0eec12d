"""Exact quantiles per group without holding a group in memory.

Equal values are counted first, then ranked with the running-total machinery; the two order statistics around
each requested rank come out of one aggregate. Ranks are exact integers: fraction k/q of n values sits at
k*(n-1)/q.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenflow.operators.order import null_safe_join, ordered_stream, running_totals
from evenflow.session import materialize


def count_values(df: DataFrame, by: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Distinct values per group with how often they occur (``n``), stored: ranking reads them more than once."""
    return materialize(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def rank_values(counted: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add how many rows of the group come before each value (``before``)."""
    ordered = ordered_stream(counted, by, [value])
    return running_totals(ordered, {"before": F.col("n")}, inclusive=False).drop(ordered.pos)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[tuple[int, int]],
                    out: str = "quantiles") -> DataFrame:
    """Linearly interpolated quantiles k/q as one array per group."""
    return quantiles_of_counts(count_values(df, by, value), by, value, fractions, out)


def quantiles_of_counts(counted: DataFrame, by: Sequence[str], value: str, fractions: Sequence[tuple[int, int]],
                        out: str = "quantiles", ranked: DataFrame | None = None) -> DataFrame:
    """The same from a table of counted values, and its ranks if they are there already."""
    ranked = rank_values(counted, by, value) if ranked is None else ranked
    sizes = counted.groupBy(*by).agg(F.sum("n").alias("_size"))
    sized = null_safe_join(ranked, sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))  # one size row

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    distinct = sorted({Fraction(k, q) for k, q in fractions})
    picks = []
    for i, share in enumerate(distinct):
        low = F.expr(f"({share.numerator} * (_size - 1)) div {share.denominator}")
        picks += [at(low).alias(f"_lo{i}"), at(F.least(low + 1, F.col("_size") - 1)).alias(f"_hi{i}")]
    found = sized.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)

    def edge(share: Fraction) -> Column:
        i = distinct.index(share)
        rest = F.expr(f"({share.numerator} * (_size - 1)) % {share.denominator}")
        between = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (rest / F.lit(share.denominator))
        return F.when(rest == 0, F.col(f"_lo{i}")).otherwise(between).cast("double")

    return found.select(*by, F.array(*[edge(Fraction(k, q)) for k, q in fractions]).alias(out))


def medians(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group."""
    return exact_quantiles(df, by, value, [(1, 2)]).select(*by, F.col("quantiles")[0].alias(out))

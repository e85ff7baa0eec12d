"""Run statistics: describe, paired t-test, Wilcoxon signed-rank, significance tables.

Statistics are plain aggregates; groups may be of any size. Only the final p-values, one row per group, are
computed in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenflow.functions.pvalues import signed_rank_p, student_t_p
from evenflow.operators.order import null_safe_join
from evenflow.operators.quantiles import count_values, medians, quantiles_of_counts, rank_values
from evenflow.session import materialize

#: Up to this many pairs without ties or zeros the signed-rank p-value is exact.
EXACT_PAIRS = 50


def _join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    if not by:
        return left.crossJoin(F.broadcast(right))  # both sides are one aggregated row
    return null_safe_join(left, right, by, how)


def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to (keys, metric, value)."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def describe(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, median, mode (smallest on ties) with a several-modes flag, and sample deviation."""
    df = materialize(df.select(*by, F.col(value).cast("double").alias(value)))
    basics = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )
    frequency = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_times"))
    levels = frequency.groupBy(*by, "_times").agg(F.count(F.lit(1)).alias("_values"), F.min(value).alias("_least"))
    modes = levels.groupBy(*by).agg(
        F.max_by("_least", "_times").alias("mode"),
        F.max_by("_values", "_times").alias("_modes"),
        F.sum("_values").alias("_distinct"),
    )
    joined = _join(_join(basics, medians(df, by, value), by), modes, by)
    return joined.select(
        *by, "n", "mean", "median", "mode",
        ((F.col("_modes") > 1) & (F.col("_distinct") != F.col("n"))).alias("several_modes"), "std",
    )


def paired_t(df: DataFrame, by: Sequence[str], base: str, other: str) -> DataFrame:
    """t = mean(d) / (sd(d) / sqrt(n)) for d = other - base, with the two-sided p-value."""
    d = F.col(other) - F.col(base)
    sums = df.where(d.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd")
    )
    ratio = F.col("mean_diff") / (F.col("_sd") / F.sqrt("n"))
    constant = F.when(F.col("mean_diff") == 0, F.lit(float("nan"))).otherwise(
        F.signum("mean_diff") * F.lit(float("inf"))
    )
    stat = F.when(F.col("_sd") > 0, ratio).when(F.col("_sd") == 0, constant)
    return sums.withColumn("t_stat", stat).withColumn(
        "t_p", student_t_p("t_stat", (F.col("n") - 1).cast("double"))
    ).drop("_sd")


def wilcoxon(df: DataFrame, by: Sequence[str], base: str, other: str) -> DataFrame:
    """Signed-rank test: zero differences drop out, ties share average ranks, variance is tie-corrected."""
    d = F.col(other) - F.col(base)
    sizes = df.where(d.isNotNull()).select(*by, F.abs(d).alias("_size"), (d > 0).alias("_up"))
    counted = count_values(sizes, by, "_size", [F.count_if("_up").alias("_up")])
    return _signed_ranks(rank_values(counted, by, "_size"), by, "_size")


def _signed_ranks(ranked: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """The test from ranked sizes of differences (``before``, ``n`` and ``_up`` per size), zeros among them."""
    nonzero = F.col(size) > 0
    tied = F.col("n").cast("double")  # cubes of a long would overflow
    sums = ranked.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(nonzero, F.col("n"))), F.lit(0)).alias("n_nonzero"),
        F.coalesce(F.sum(F.when(~nonzero, F.col("n"))), F.lit(0)).alias("_zeros"),
        F.sum(F.col("_up") * (F.col("before") + (F.col("n") + 1) / 2)).alias("_ranks"), F.sum("_up").alias("_ups"),
        F.sum(F.when(nonzero, tied * tied * tied - tied)).alias("_ties"),
    )
    n, many = F.col("n_nonzero"), F.col("n_nonzero").cast("double")
    spread = F.sqrt(many * (many + 1) * (2 * many + 1) / 24 - F.col("_ties") / 48)
    exact = (n <= EXACT_PAIRS) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
    return sums.withColumn("w_plus", F.col("_ranks") - F.col("_ups") * F.col("_zeros")).withColumn(  # zeros come first
        "wilcoxon_z", (F.col("w_plus") - many * (many + 1) / 4) / F.nullif(spread, F.lit(0.0))
    ).withColumn(
        "wilcoxon_p",
        F.when(n == 0, F.lit(1.0)).otherwise(
            signed_rank_p("w_plus", "wilcoxon_z", n.cast("double"), F.coalesce(exact, F.lit(False)))
        ),
    ).select(*by, "n_nonzero", "w_plus", "wilcoxon_z", "wilcoxon_p")


def paired_summary(df: DataFrame, by: Sequence[str], base: str, other: str) -> DataFrame:
    """n, mean, median, deviation of both sides, change, paired t and Wilcoxon. Equal sides give p = 1."""
    df, d = materialize(df.select(*by, base, other)), F.col(other) - F.col(base)  # read three times
    sides = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        x for c in (base, other)
        for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))
    ])
    # Both sides and the sizes of the differences are counted and ranked as one long table.
    cells = [F.struct(F.lit(kind).alias("_kind"), value.cast("double").alias("_v"), up.alias("_up")) for kind, value, up in (
        ("base", F.col(base), F.lit(False)), ("other", F.col(other), F.lit(False)), ("size", F.abs(d), d > 0))]
    long = df.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")
    keys = [*by, "_kind"]
    counted = count_values(long, keys, "_v", [F.count_if("_up").alias("_up")])
    ranked = materialize(rank_values(counted, keys, "_v"))
    middle = quantiles_of_counts(counted, keys, "_v", [(1, 2)], ranked=ranked).groupBy(*by).agg(*[
        F.max(F.when(F.col("_kind") == kind, F.col("quantiles")[0])).alias(f"{c}_median") for kind, c in (("base", base), ("other", other))])
    joined = _join(sides, middle, by)
    joined = _join(joined, paired_t(df, by, base, other).drop("n", "mean_diff"), by)
    joined = _join(joined, _signed_ranks(ranked.where("_kind = 'size'"), by, "_v"), by)
    testable = (F.col("n") > 1) & (F.col("n_nonzero") > 0)
    return joined.select(
        *by, "n", *[f"{c}_{m}" for c in (base, other) for m in ("mean", "median", "std")],
        (F.col(f"{other}_mean") - F.col(f"{base}_mean")).alias("mean_diff"),
        ((F.col(f"{other}_mean") - F.col(f"{base}_mean")) * 100 / F.nullif(F.col(f"{base}_mean"), F.lit(0.0)))
        .alias("pct_change"),
        F.when(testable, F.col("t_stat")).otherwise(F.lit(float("nan"))).alias("t_stat"),
        F.when(testable, F.col("t_p")).otherwise(F.lit(1.0)).alias("t_p"),
        F.when(testable, F.col("wilcoxon_z")).alias("wilcoxon_z"),
        F.when(testable, F.col("wilcoxon_p")).otherwise(F.lit(1.0)).alias("wilcoxon_p"),
    )


def significance(metrics: DataFrame, by: Sequence[str], primary: str, run: str = "run_id",
                 strategy: str = "strategy") -> DataFrame:
    """Every other strategy against the primary one, per metric, paired by run; flag at p < .05.

    ``metrics`` is long: (by, run, strategy, metric, value).
    """
    keys = [*by, run, "metric"]
    best = metrics.where(F.col(strategy) == primary).select(*keys, F.col("value").alias("primary_value"))
    rest = metrics.where(F.col(strategy) != primary).select(*keys, strategy, F.col("value").alias("base_value"))
    pairs = materialize(null_safe_join(rest, best, keys))
    groups = [*by, strategy, "metric"]
    means = pairs.groupBy(*groups).agg(
        F.avg("base_value").alias("base_mean"), F.avg("primary_value").alias("primary_mean")
    )
    tested = _join(means, paired_t(pairs, groups, "base_value", "primary_value"), groups)
    tested = _join(tested, wilcoxon(pairs, groups, "base_value", "primary_value"), groups)
    return tested.withColumn("significant", F.coalesce(F.col("t_p") < 0.05, F.lit(False)) & ~F.isnan("t_p"))

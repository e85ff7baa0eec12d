"""Parameter grids: sweeps over (W, s, X), phases, missing configurations, averages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenflow.operators.bounds import Bounds
from evenflow.operators.monitor import monitor_summaries
from evenflow.operators.order import OrderedStream
from evenflow.operators.prep import valid_config
from evenflow.operators.stateful import RepairCase, case_metrics

# The standard experiment grid. Each sweep varies one parameter and fixes the other two.
SWEEPS = {
    "W": {"window": [100, 200, 500, 1000, 2000], "block": [50], "landmark": [100]},
    "s": {"window": [1000], "block": [25, 50, 100, 250], "landmark": [500]},
    "X": {"window": [500], "block": [50], "landmark": [50, 100, 250, 500]},
}
# The two standard phases.
PHASES = {
    "slow": (500, ["naive", "optimal", "internal_swap", "greedy_swap", "weighted_greedy_swap"]),
    "fast": (5000, ["naive", "optimal", "internal_swap"]),
}
CONFIG = ["window", "block", "landmark"]


def sweep_table(spark: SparkSession, sweeps: Mapping[str, Mapping[str, Sequence[int]]] = SWEEPS) -> DataFrame:
    """(sweep, window, block, landmark) for every point of every sweep."""
    points = [
        (name, w, s, x) for name, axis in sweeps.items()
        for w in axis["window"] for s in axis["block"] for x in axis["landmark"]
    ]
    return spark.createDataFrame(points, "sweep string, window int, block int, landmark int")


def grid_configs(points: DataFrame, categories: int | None = None, whole_blocks: bool = True) -> DataFrame:
    """Valid distinct configurations with the sweeps they belong to."""
    valid = valid_config(F.col("window"), F.col("block"), F.col("landmark"), categories, whole_blocks)
    return points.where(valid).groupBy(*CONFIG).agg(
        F.array_join(F.sort_array(F.collect_list("sweep")), ",").alias("sweeps")
    )


def phase_table(spark: SparkSession, phases: Mapping[str, tuple[int, Sequence[str]]] = PHASES) -> DataFrame:
    """(phase, max_windows, strategy)."""
    rows = [(name, limit, s) for name, (limit, strategies) in phases.items() for s in strategies]
    return spark.createDataFrame(rows, "phase string, max_windows int, strategy string")


def run_plan(configs: DataFrame, phases: DataFrame, runs: int) -> DataFrame:
    """Every configuration x phase x strategy x run; all three inputs are small configuration tables."""
    numbers = configs.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run_id"))
    return configs.crossJoin(F.broadcast(phases)).crossJoin(F.broadcast(numbers))


def missing_configs(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configurations that have no result yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def monitor_grid(stream: OrderedStream, attr: str, counts: Mapping[str, int],
                 configs: Sequence[tuple[int, int, int]], max_windows: int | None = None) -> DataFrame:
    """Monitor summary of every configuration and run as one job.

    Block counts depend only on the block size, so all windows of one block size share a pass; the look-ahead
    does not touch monitoring and only labels the rows.
    """
    parts = []
    for block in sorted({s for _, s, _ in configs}):
        windows = sorted({w for w, s, _ in configs if s == block})
        bounds = Bounds.from_counts(counts, block)
        shared = monitor_summaries(stream, attr, {str(w): (bounds, w) for w in windows}, max_windows)
        points = F.array(*[
            F.struct(F.lit(w).alias("window"), F.lit(s).alias("block"), F.lit(x).alias("landmark"))
            for w, s, x in configs if s == block
        ])
        matched = shared.withColumn("_c", F.explode(points)).where(F.col("case") == F.col("_c.window").cast("string"))
        parts.append(matched.select("_c.*", *[c for c in shared.columns if c != "case"]))
    return _union(parts)


def repair_grid(stream: OrderedStream, attr: str, counts: Mapping[str, int],
                configs: Sequence[tuple[int, int, int]], strategies: Sequence[str], primary: str = "optimal",
                max_windows: int | None = None) -> DataFrame:
    """Strategy metrics per configuration and stream key (run); all configurations are one shuffle and one sort."""
    cases = [RepairCase(w, s, x, tuple(strategies), max_windows) for w, s, x in configs]
    return with_case(case_metrics(stream, attr, counts, cases, primary),
                     {c: [getattr(case, c) for case in cases] for c in CONFIG})


def with_case(results: DataFrame, columns: Mapping[str, Sequence]) -> DataFrame:
    """Replace the number of a case by its values."""
    named = [F.get(F.array(*[F.lit(v) for v in values]), F.col("case")).alias(name) for name, values in columns.items()]
    return results.select(*named, *[c for c in results.columns if c != "case"])


def config_averages(results: DataFrame, configs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of every metric per configuration, with the sweeps it belongs to."""
    means = results.groupBy(*CONFIG, *by).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.join(F.broadcast(configs.select(*CONFIG, "sweeps")), CONFIG, "left")  # one row per configuration


def sweep_summary(results: DataFrame, points: DataFrame, sweep: str, parameter: str, metric: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of a metric along one sweep."""
    along = points.where(F.col("sweep") == sweep).select(*CONFIG).distinct()
    return results.join(F.broadcast(along), CONFIG).groupBy(F.col(parameter).alias("sweep_value"), *by).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")
    )

"""A whole experiment: seeded runs of a table through every configuration, phase and strategy, and its report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenflow.operators import stats
from evenflow.operators.bounds import category_counts
from evenflow.operators.grid import CONFIG, PHASES, grid_configs, missing_configs, with_case
from evenflow.operators.prep import seeded_runs
from evenflow.operators.stateful import RepairCase, case_metrics
from evenflow.sources.sinks import write_table

# The metrics a report describes and tests, per strategy.
METRICS = ("compat_pct_fair", "compat_pct_fair_windows", "pct_fair", "pct_fair_windows", "fair_blocks",
           "fair_windows", "total_swaps")


def run_experiment(df: DataFrame, attribute: str, row_id: Sequence[str], points: DataFrame, runs: int = 10,
                   phases: Mapping[str, tuple[int | None, Sequence[str]]] = PHASES, primary: str = "optimal",
                   done: DataFrame | None = None) -> DataFrame:
    """(window, block, landmark, phase, run_id, strategy, metrics...) for every valid point, phase and run, in one job.

    ``points`` is a sweep table. A (point, phase) that ``done`` already holds is skipped. A phase bounds its runs to a
    number of windows; None lets a run read its whole table.
    """
    counts = category_counts(df, attribute)
    wanted = _wanted(points, len(counts), phases, done)
    if not wanted:
        raise ValueError("no configuration is left to run")
    return _run(df, attribute, row_id, counts, wanted, runs, phases, primary)


def resume_experiment(df: DataFrame, attribute: str, row_id: Sequence[str], points: DataFrame, ledger: str,
                      runs: int = 10, phases: Mapping[str, tuple[int | None, Sequence[str]]] = PHASES,
                      primary: str = "optimal") -> DataFrame:
    """The same, kept as a table at ``ledger``, partitioned by configuration and phase; returns the whole table.

    What the ledger holds is not computed again. Each phase is one job and one commit, which replaces only the
    partitions it made, so a lost driver costs the phase that was running. A ledger belongs to one table, attribute,
    number of runs and primary strategy.
    """
    spark = df.sparkSession
    counts = category_counts(df, attribute)
    for name, phase in phases.items():
        wanted = _wanted(points, len(counts), {name: phase}, read_ledger(spark, ledger))
        if wanted:
            made = _run(df, attribute, row_id, counts, wanted, runs, phases, primary)
            write_table(made, ledger, [*CONFIG, "phase"])
    kept = read_ledger(spark, ledger)
    if kept is None:
        raise ValueError("the points hold no valid configuration")
    return kept


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The results at ``ledger``; None where nothing was written yet."""
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _wanted(points: DataFrame, categories: int, phases: Mapping[str, tuple], done: DataFrame | None) -> list[tuple]:
    """(window, block, landmark, phase) without results; a configuration table, whose size the caller set."""
    names = points.sparkSession.createDataFrame([(name,) for name in phases], "phase string")
    wanted = grid_configs(points, categories).crossJoin(F.broadcast(names))
    if done is not None:
        wanted = missing_configs(wanted, done, [*CONFIG, "phase"])
    return [tuple(r) for r in wanted.orderBy(*CONFIG, "phase").select(*CONFIG, "phase").collect()]


def _run(df, attribute, row_id, counts, wanted, runs, phases, primary) -> DataFrame:
    cases = [RepairCase(w, s, x, tuple(phases[name][1]), phases[name][0]) for w, s, x, name in wanted]
    stream = seeded_runs(df.select(attribute, *row_id), runs, row_id)
    columns = dict(zip([*CONFIG, "phase"], zip(*wanted, strict=True), strict=True))
    return with_case(case_metrics(stream, attribute, counts, cases, primary), columns)


def describe_experiment(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean, median, mode and deviation over runs, per configuration, phase, strategy and metric."""
    keys = [*CONFIG, "phase", "strategy"]
    return stats.describe(stats.unpivot_metrics(results, [*keys, "run_id"], metrics), [*keys, "metric"])


def compare_experiment(results: DataFrame, primary: str = "optimal", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Every strategy against the primary one, paired by run."""
    keys = [*CONFIG, "phase"]
    long = stats.unpivot_metrics(results.where("strategy <> 'before'"), [*keys, "run_id", "strategy"], metrics)
    return stats.significance(long, keys, primary)

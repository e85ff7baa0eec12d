"""Preparation, sources and sinks, ranking quality, statistics, grids."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenflow.functions import columns as fc
from evenflow.functions.pvalues import signed_rank_exact, student_t_two_sided
from evenflow.operators import experiment, grid, prep, ranking, stateful, stats
from evenflow.operators.bounds import Bounds, category_counts
from evenflow.operators.order import ordered_stream
from evenflow.operators.quantiles import exact_quantiles
from evenflow.sources import sinks, tables


def test_column_helpers(spark):
    df = spark.createDataFrame([(" a ", "x"), (None, "y"), ("b", None)], "v string, w string")
    got = df.select(
        fc.recode(fc.clean_text("v"), {"a": "first"}, "rest").alias("r"), fc.crossed(["v", "w"]).alias("c"),
        fc.bucket(fc.clean_text("v"), {"ab": ["a", "b"]}, "none").alias("b"),
    ).collect()
    assert [r.r for r in got] == ["first", "rest", "rest"]
    assert [r.c for r in got] == [" a  | x", None, None]
    assert [r.b for r in got] == ["ab", "none", "ab"]
    with pytest.raises(PySparkException, match="value in no bucket"):
        df.select(fc.bucket(F.col("v"), {"ab": ["b"]})).collect()


def test_filters_and_top_k(spark):
    df = spark.createDataFrame([(v,) for v in ["a", "a", "c", "b", None, "d"]], "v string")
    assert prep.drop_value(df, "v", "a").count() == 4
    assert prep.keep_members(df, "v", ["a", "b"]).count() == 3
    top = {r.v: r.t for r in prep.collapse_to_top(df, "v", 2, "t").collect()}
    assert top == {"a": "a", "b": "b", "c": "Other", "d": "Other", None: "Other"}


def test_intersectional_distribution_from_another_source(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", None)], "x string, y int")
    assert {r.category: r.n for r in prep.intersectional_distribution(df, ["x", "y"]).collect()} == {"a | 1": 2, "b | 2": 1}
    only = prep.intersectional_distribution(df, ["x", "y"], df.where("x = 'b'")).collect()
    assert [r.category for r in only] == ["b | 2"]


def test_quantile_bins(spark):
    values = [0, 1, 4, 9, 16, 25, 36, 49, 64, 81, 4, 9]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    model = prep.fit_quantile_bins(df, "v", 4)
    assert [r[0] for r in df.select(model.code()).collect()] == [0, 0, 0, 1, 2, 2, 2, 3, 3, 3, 0, 1, None]
    assert model.label(list("abcd")) is not None
    with pytest.raises(ValueError):
        model.label(["low", "high"])
    same = prep.fit_adaptive_bins(spark.createDataFrame([(7.0,)] * 4, "v double"), "v")
    assert same.size == 1
    summary = prep.bin_summary(df.dropna(), model).orderBy("bin").collect()
    assert [r["count"] for r in summary] == [4, 2, 3, 3] and summary[0].range.startswith("[0.00")
    assert summary[1].range.startswith("(") and summary[0].percent == "33.3%"


def test_adaptive_bins_drop_small_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 50 + [2] * 45 + [3] * 5], "v double")
    model = prep.fit_adaptive_bins(df, "v", 5, 0.15)
    sizes = {r[0]: r[1] for r in model.transform(df, "b").groupBy("b").count().collect()}
    assert min(sizes.values()) / 100 >= 0.15


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(k, float(v)) for k in "ab" for v in rng.integers(0, 40, 101 if k == "a" else 64)]
    df = spark.createDataFrame(data, "k string, v double")
    got = exact_quantiles(df, ["k"], "v", [(0, 1), (1, 4), (1, 2), (9, 10), (1, 1)]).collect()
    for row in got:
        mine = [v for k, v in data if k == row.k]
        assert row.quantiles == pytest.approx(np.quantile(mine, [0, 0.25, 0.5, 0.9, 1.0]).tolist())


def test_seeded_runs_are_reproducible(events):
    a = prep.seeded_runs(events.select("event_id"), 2, ["event_id"])
    b = prep.seeded_runs(events.select("event_id").repartition(5), 2, ["event_id"], how="range")
    assert sorted(map(tuple, a.df.select("run_id", "pos", "event_id").collect())) == sorted(
        map(tuple, b.df.select("run_id", "pos", "event_id").collect()))
    first = [r.event_id for r in a.df.where("run_id = 1").orderBy("pos").collect()]
    assert first != sorted(first)


def test_csv_dates_and_projection(spark, tmp_path):
    (tmp_path / "in.csv").write_text("day,group,n\n2024-02-03,a,1\n05/04/2024,--,x\nNA,b,3\n31/12/2024, ,4\n")
    schema = StructType.fromDDL("day string, group string, n int")
    raw = tables.read_csv(spark, str(tmp_path / "in.csv"), schema)
    assert [tuple(r) for r in raw.collect()] == [
        ("2024-02-03", "a", 1), ("05/04/2024", None, None), (None, "b", 3), ("31/12/2024", None, 4)]
    kept, counts = tables.clean_dates(raw, "day", day_first=True)
    assert [str(r.day)[:10] for r in kept.collect()] == ["2024-02-03", "2024-04-05", "2024-12-31"]
    assert counts.get == {"total": 4, "kept": 3}
    month_first, _ = tables.clean_dates(raw, "day")
    assert [str(r.day)[:10] for r in month_first.collect()] == ["2024-02-03", "2024-05-04"]
    assert tables.project(raw, "group", ["n", "group"]).columns == ["group", "n"]


def test_prepare_stream_keeps_extra_columns(events):
    ready, attribute, model = tables.prepare_stream(events, "value", False, ["event_id"])
    assert attribute == "value_bin" and ready.columns == ["value_bin", "event_id"] and model.size > 1
    ready, attribute, model = tables.prepare_stream(events, "event_type", True, ["event_id"])
    assert attribute == "event_type" and model is None and ready.columns == ["event_type", "event_id"]


def test_attribute_catalog(events):
    rows = tables.attribute_catalog(events, ["event_type", "user_id"]).where("attribute = 'event_type'").orderBy("rank").collect()
    values = [r.value for r in rows]
    assert values == sorted(values) and len(values) == 5 and [r["rank"] for r in rows] == list(range(5))


def test_chunk_files_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a")], "run_id int, position_in_chunk int, g string")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "W40_s20_X20_fast.csv"))
    back = tables.read_chunk_files(spark, str(tmp_path / "W40_s20_X20_fast.csv"), df.schema)
    assert back.first().block == 20
    with pytest.raises(PySparkException, match="no block size in"):
        spark.range(1).select(tables.block_size_of(F.lit("W40_X20"))).collect()


def test_sinks_replace_only_touched_partitions(spark, tmp_path, events):
    path = str(tmp_path / "metrics")
    make = lambda w, v: spark.createDataFrame([(w, 10, 5, v)], "window int, block int, landmark int, v int")
    sinks.write_metrics(make(20, 1).unionByName(make(40, 2)), path)
    sinks.write_metrics(make(40, 3), path)
    assert sorted((r.window, r.v) for r in spark.read.parquet(path).collect()) == [(20, 1), (40, 3)]
    sinks.write_bounds(events, "event_type", 10, str(tmp_path / "bounds"))
    assert spark.read.option("header", True).csv(str(tmp_path / "bounds")).columns == [
        "category", "percentage", "reorder_target", "floor", "ceiling"]
    captures = make(20, 1).withColumn("phase", F.lit("original"))
    sinks.write_captures(captures, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).first().phase == "original"


def test_ndcg(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 2.0), (2, 0, 0.0), (2, 1, 0.0), (3, 0, None),
                                (3, 1, 2.0)], "c int, p int, r double")
    got = {r.c: r.ndcg for r in ranking.ndcg_windows(df, ["c"], "p", "r").collect()}
    assert got[1] == pytest.approx(0.817494, abs=1e-6) and got[2] is None
    assert got[3] == pytest.approx(1 / np.log2(3))
    blocks = {(r.c, r.block_index): r.ndcg for r in ranking.ndcg_blocks(df, ["c"], "p", "r", 2).collect()}
    assert blocks[(1, 1)] == 1.0 and blocks[(2, 0)] is None


def test_ndcg_report_pairs_and_drops(spark):
    rows = [(p, c, i, float(r)) for p, order in (("original", [3, 1, 2]), ("reordered", [3, 1, 2]))
            for c in (1, 2) for i, r in enumerate(order)] + [("original", 9, 0, 1.0)]
    df = spark.createDataFrame(rows, "phase string, c int, position_in_chunk int, r double")
    report = {r.cutoff: r for r in ranking.ndcg_report(df, [], ["c"], "r", 3, [50]).collect()}
    assert set(report) == {"block_size", "50", "per_block"}
    row = report["block_size"]
    assert row.n == 2 and row.mean_diff == 0.0 and row.t_p == 1.0 and row.wilcoxon_p == 1.0 and np.isnan(row.t_stat)


def test_paired_tests(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 5.0), (1, 4.0, 4.0), (1, 5.0, 8.0)],
                               "k int, a double, b double")
    t = stats.paired_t(df, ["k"], "a", "b").first()
    assert t.t_stat == pytest.approx(2.057983, abs=1e-6)
    w = stats.wilcoxon(df, ["k"], "a", "b").first()
    assert (w.n_nonzero, w.w_plus) == (3, 6.0) and w.wilcoxon_z == pytest.approx(1.603567, abs=1e-6)
    equal = stats.wilcoxon(df.withColumn("b", F.col("a")), [], "a", "b").first()
    assert equal.n_nonzero == 0 and equal.wilcoxon_p == 1.0
    shifted = stats.paired_t(df.withColumn("b", F.col("a") + 1), [], "a", "b").first()
    assert np.isinf(shifted.t_stat) and shifted.t_p == 0.0


def test_p_values():
    assert student_t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert student_t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert student_t_two_sided(3.0, 1e6) == pytest.approx(0.0027, abs=1e-4)
    sums = [sum(r for r, s in zip(range(1, 7), signs, strict=True) if s) for signs in product([0, 1], repeat=6)]
    for w in (0, 3, 10, 21):
        both = 2 * min(sum(x <= w for x in sums), sum(x >= w for x in sums)) / len(sums)
        assert signed_rank_exact(w, 6) == pytest.approx(min(1.0, both))


def test_describe(spark):
    df = spark.createDataFrame([("m", v) for v in [1.0, 2.0, 2.0, 3.0, 3.0]] + [("u", v) for v in [1.0, 2.0]] + [("o", 4.0)],
                               "k string, value double")
    got = {r.k: r for r in stats.describe(df, ["k"]).collect()}
    assert (got["m"].mode, got["m"].several_modes, got["m"].median) == (2.0, True, 2.0)
    assert (got["u"].mode, got["u"].several_modes) == (1.0, False) and got["o"]["std"] == 0.0


def test_significance(spark):
    data = [(run, s, "m", float(run + (3 if s == "best" else run % 3))) for run in range(1, 11) for s in ("best", "other")]
    df = spark.createDataFrame(data, "run_id int, strategy string, metric string, value double")
    row = stats.significance(df, [], "best").first()
    assert row.strategy == "other" and row.n == 10 and row.significant and row.primary_mean > row.base_mean


def test_grid(spark, events):
    points = grid.sweep_table(spark)
    configs = grid.grid_configs(points, 5)
    assert configs.where("window = 500 AND landmark = 100").first().sweeps == "W,X"
    assert configs.count() == 12 and grid.grid_configs(points, 30).where("block = 25").count() == 0
    odd = spark.createDataFrame([("X", 500, 25, 7)], points.schema)
    assert grid.grid_configs(odd).count() == 0 and grid.grid_configs(odd, whole_blocks=False).count() == 1
    plan = grid.run_plan(configs, grid.phase_table(spark), 2)
    assert plan.count() == 12 * (5 + 3) * 2
    runs = prep.seeded_runs(events.select("event_id", "event_type"), 2, ["event_id"])
    counts = {r[0]: r[1] for r in events.groupBy("event_type").count().orderBy("event_type").collect()}
    done = grid.repair_grid(runs, "event_type", counts, [(100, 50, 50), (50, 25, 25)], ["optimal", "naive"], max_windows=200)
    assert done.groupBy(*grid.CONFIG).count().count() == 2
    assert grid.missing_configs(configs, done, grid.CONFIG).count() == 12
    means = grid.config_averages(done, configs, ["pct_fair"], ["strategy"])
    assert means.count() == 6


def test_experiment(spark, events):
    points = grid.sweep_table(spark, {"W": {"window": [40, 60], "block": [20], "landmark": [20]}})
    run = lambda done=None: experiment.run_experiment(
        events, "event_type", ["event_id"], points, runs=3, phases={"p": (100, ["naive", "optimal"])}, done=done)
    results = run()
    assert results.count() == 2 * 3 * 3
    bounded = results.where("strategy = 'before'").select((F.col("edits") + F.col("fair_checks")).alias("checks"))
    assert bounded.where("checks > 100").count() == 0
    table = experiment.compare_experiment(results)
    assert table.select("strategy").distinct().collect()[0].strategy == "naive"
    assert experiment.describe_experiment(results, ["pct_fair"]).count() == 2 * 3
    rest = run(results.where("window = 40"))
    assert [r.window for r in rest.select("window").distinct().collect()] == [60]
    with pytest.raises(ValueError):
        run(results)


def test_cases_in_one_pass_equal_single_runs(spark, events):
    """Every case of the grid has the metrics of its own repair, bounded or not."""
    runs = prep.seeded_runs(events.select("event_id", "event_type").where("event_id % 3 = 0"), 2, ["event_id"])
    counts = category_counts(events, "event_type")
    cases = [stateful.RepairCase(40, 20, 20, ("optimal", "naive")), stateful.RepairCase(60, 20, 40, ("greedy_swap",), 90),
             stateful.RepairCase(30, 10, 10, ("naive_reversed",), 10**9)]
    got = stateful.case_metrics(runs, "event_type", counts, cases)
    for number, c in enumerate(cases):
        trace = stateful.stateful_repair(runs, "event_type", Bounds.from_counts(counts, c.block), c.window, c.landmark,
                                         max_windows=c.max_windows)
        want = stateful.strategy_metrics(trace, c.strategies, ["run_id"])
        mine = got.where(F.col("case") == number).select(*want.columns)
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect()))


def test_experiment_resumes_from_its_ledger(spark, events, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    points = lambda *sizes: grid.sweep_table(spark, {"W": {"window": sizes, "block": [20], "landmark": [20]}})
    phases = {"short": (50, ["naive"]), "long": (120, ["naive", "optimal"])}
    run = lambda p: experiment.resume_experiment(events, "event_type", ["event_id"], p, ledger, 2, phases)
    first = run(points(40))
    assert first.groupBy("phase").count().orderBy("phase").collect() == [("long", 6), ("short", 4)]
    kept = sorted(map(tuple, first.select(sorted(first.columns)).collect()))
    second = run(points(40, 60))
    assert sorted(map(tuple, second.where("window = 40").select(sorted(first.columns)).collect())) == kept
    assert second.where("window = 60").count() == 10
    monkeypatch.setattr(experiment, "case_metrics", lambda *_: pytest.fail("nothing is left to compute"))
    assert run(points(40, 60)).count() == 20


def test_minute_clock(spark):
    stream = ordered_stream(spark.range(3), [], ["id"])
    assert [str(r.t) for r in prep.minute_clock(stream, "t").orderBy("id").collect()][2] == "2020-01-01 00:02:00"

"""Segments that run at the same time give the rows, edits and sums of the one sequential run."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenflow.operators.bounds import fit_bounds
from evenflow.operators.order import ordered_stream
from evenflow.operators.segments import segmented_repair
from evenflow.operators.stateful import stateful_repair


def rows_of(df):
    return sorted(map(str, df.collect()))


def sample(spark, n):
    letter = F.element_at(F.array(*map(F.lit, "abcd")), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"))
    calm = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(0, n, 1, 4).select("id", (F.col("id") % 1000 == 0).alias("k"),
                                          F.when(F.col("id") % 500 < 150, letter).otherwise(calm).alias("c"))


@pytest.mark.parametrize(("n", "segment", "warm_up", "primary"), [
    (1500, 100, 60, "naive_reversed"),  # many borders inside unfair stretches
    (1999, 333, 0, "optimal"),          # no guess at all
    (640, 64, 500, "optimal"),          # warm-up of several segments, rows end on a border
    (45, 40, 20, "optimal"),            # less than a second chunk
])
def test_equals_the_sequential_run(spark, n, segment, warm_up, primary):
    df = sample(spark, n)
    bounds = fit_bounds(df, "c", 10)
    stream = ordered_stream(df, [], ["id"])
    one = stateful_repair(stream, "c", bounds, 20, 10, primary).materialized()
    many = segmented_repair(stream, "c", bounds, 20, 10, primary, segment_rows=segment, warm_up=warm_up)
    for part in ("delivered", "captures", "summaries"):
        assert rows_of(getattr(many, part)()) == rows_of(getattr(one, part)()), part


def test_keys_with_null_and_an_empty_stream(spark):
    df = sample(spark, 1500).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    bounds = fit_bounds(df, "c", 10)
    for rows in (df, df.where("id < 0")):
        stream = ordered_stream(rows, ["k"], ["id"])
        one = stateful_repair(stream, "c", bounds, 20, 10)
        many = segmented_repair(stream, "c", bounds, 20, 10, segment_rows=100, warm_up=50)
        assert rows_of(many.delivered()) == rows_of(one.delivered())


def test_a_long_key_runs_in_many_tasks(spark):
    df = sample(spark, 200_000)
    bounds = fit_bounds(df, "c", 10)
    stream = ordered_stream(df, [], ["id"])
    trace = segmented_repair(stream, "c", bounds, 20, 10, log_edits=False, segment_rows=1 << 14)
    assert trace.summaries().count() == 1
    one = stateful_repair(stream, "c", bounds, 20, 10, log_edits=False)
    got, want = ([r.pos for r in t.delivered().orderBy("out_pos").select("pos").collect()] for t in (trace, one))
    assert np.array_equal(got, want)
    with pytest.raises(ValueError, match="segment"):
        segmented_repair(stream, "c", bounds, 20, 10, segment_rows=20)

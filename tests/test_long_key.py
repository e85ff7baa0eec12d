"""The windowed repair over one key of more than 10,000 rows is one uncut run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evenflow.operators.bounds import fit_bounds
from evenflow.operators.order import ordered_stream
from evenflow.operators.stateful import stateful_repair
from evenflow.plans.episode import Episode
from evenflow.plans.registry import strategy, template_function


def test_one_run_however_long(spark):
    rows = spark.range(0, 23_000, 1, 5).select("id", F.element_at(F.array(*map(F.lit, "abcd")), (F.pmod(F.hash("id"), F.lit(4)) + 1)).alias("c"))
    bounds = fit_bounds(rows, "c", 10)
    trace = stateful_repair(ordered_stream(rows, [], ["id"]), "c", bounds, 20, 10, log_edits=False)
    got = [r.id for r in trace.delivered(["id"]).orderBy("out_pos").collect()]
    labels = np.array([bounds.categories.index(r.c) for r in rows.orderBy("id").collect()])
    run = Episode(20, 10, 10, np.array(bounds.floor), np.array(bounds.ceiling), template_function(strategy("optimal"), bounds, 20))
    run.feed(np.arange(len(labels)), labels)
    want = np.concatenate([run.take(), run.finish()])
    assert got == want.tolist()
    assert trace.summaries().count() == 1

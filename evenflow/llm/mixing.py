"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``most``, the rates closest to 1 in relative entropy whose token sums meet the
targets are exponentially tilted: min(most, exp(lambda_source * size / mean size)). The multipliers solve the convex
dual; distributed Newton steps find them, all sources at once, from the table of distinct sizes. Rates become whole
copies by carrying the rounding error from larger to smaller documents inside slices of bounded size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenflow.llm.store import free_names, row_key, stored

SLICE = 4_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, n, target`` of every source of ``sizes`` (source, size).

    Sources by code point, null last, take the weights in turn and share all tokens. A target stops at ``most`` times
    its source's size and the excess is shared again by weight until no target is above. Sources are ranked in one
    task, one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    # In order of room per weight, the sources that stop come first; the level is that of the first that doesn't.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    free = F.col("most") / F.col("weight") > F.col("level")
    rows = rows.withColumn("level", F.min_by("level", F.when(free, F.col("place"))).over(everyone))
    return rows.select("source", "source_size", "n", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(multiplier * size / mean, F.lit(50.0))))


def tilts(sizes: DataFrame, targets: DataFrame, most: float = 3.0, steps: int = 60, close: float = 1e-7) -> DataFrame:
    """``key, multiplier, mean`` of every source with tokens, by safeguarded Newton steps on the dual.

    Each step is one aggregation over (source, size, count); a step that leaves its bracket is replaced by bisection.
    Only the largest relative error reaches the driver.
    """
    table = stored(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("docs")))
    docs = table.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("size").alias("smallest"))
    state = stored(targets.where("source_size > 0").join(docs, "key").select(
        "key", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.log(F.col("target") / F.col("source_size")).alias("x"),
        F.lit(-800.0).alias("low"),
        (F.log(F.lit(most)) * F.col("source_size") / F.col("docs") / F.col("smallest") + 1.0).alias("high")))
    for _ in range(steps):
        raw = F.exp(F.least(F.col("x") * F.col("size") / F.col("mean"), F.lit(50.0)))
        tokens = F.col("docs") * F.col("size")
        sums = table.join(state.select("key", "mean", "x"), "key").groupBy("key").agg(
            F.sum(tokens * F.least(F.lit(most), raw)).alias("got"),
            F.sum(F.when(raw < most, tokens * raw * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        error = F.log(F.col("got") / F.col("target"))
        state = state.join(sums, "key").withColumn("error", error)
        state = state.withColumn("low", F.when(F.col("error") < 0, F.col("x")).otherwise(F.col("low"))).withColumn(
            "high", F.when(F.col("error") > 0, F.col("x")).otherwise(F.col("high")))
        newton = F.col("x") - F.col("error") * F.col("got") / F.col("slope")
        good = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        done = F.abs("error") <= close
        state = stored(state.select(
            "key", "target", "mean",
            F.when(done, F.col("x")).when(good, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("x"), "low", "high",
            F.when(done, 0.0).otherwise(F.least(F.abs("error"), (F.col("high") - F.col("low")) / 10)).alias("left")))
        if (state.agg(F.max("left")).first()[0] or 0.0) <= close:
            break
    return state.select("key", F.col("x").alias("multiplier"), "mean")


PLAN = "doc_id long, row_key long, key string, size long, copies long"


def _round(most: int):
    def run(rows: pa.Table) -> pa.Table:
        """Whole copies of one slice: each the floor or ceiling of its rate, nearest to what is still owed."""
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("row_key", "ascending")])
        owed, copies = 0.0, []
        for size, rate in zip(rows["size"].to_pylist(), rows["rate"].to_pylist(), strict=True):
            low = int(rate + 1e-9)
            high = min(most, low if rate - low < 1e-9 else low + 1)
            owed += rate * size
            take = high if size and owed - low * size > (high - low) * size / 2 else low
            if not size:
                take = 1
            owed -= take * size
            copies.append(take)
        return rows.select(["doc_id", "row_key", "key", "size"]).append_column("copies", pa.array(copies, pa.int64()))
    return run


def _plan(docs: DataFrame, most: int, weights: tuple[int, ...], slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """A row of ``PLAN`` per row of ``docs``, and the sources' targets."""
    doc, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    sizes = stored(docs.select(doc.alias("doc_id"), row_key(doc, text).alias("row_key"), source.alias("source"),
                               word_count(text).alias("size")).withColumn("key", _key(F.col("source"))))
    targets = stored(source_targets(sizes, float(most), weights).withColumn("key", _key(F.col("source"))))
    tilt = tilts(sizes, targets, float(most))
    rated = sizes.join(targets.select("key", "n"), "key").join(tilt, "key", "left")
    rate = F.when(F.col("size") > 0, _rate(F.col("multiplier"), F.col("size"), F.col("mean"), float(most))).otherwise(1.0)
    part = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n") / slice_rows)).alias("part")
    rows = rated.select("doc_id", "row_key", "key", "size", rate.alias("rate"), part)
    return rows.groupBy("key", "part").applyInArrow(_round(most), PLAN), targets


def mix_plan(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), slice_rows: int = SLICE) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row of ``docs`` (doc_id, text, source).

    size: words of the text (null: 0). copies: how often the mix takes the row, at most ``most``; a row without words
    is taken once. taken = copies * size. A source's taken words differ from its target by rounding only, by at most
    half a document per slice. Repeated rows are rounded one by one, and reruns agree. A null doc_id is kept. An empty
    table gives no rows.
    """
    copies, targets = _plan(docs, most, weights, slice_rows)
    return copies.join(targets, "key").select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def mixed(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns stay as they are, whatever their names.

    Rows that agree in id, text and source share their copies.
    """
    own, key, source, copies, rows, each = free_names(docs, "id", "row_key", "source_key", "copies", "rows", "each")
    plan = _plan(docs, most, weights, SLICE)[0].groupBy(F.col("doc_id").alias(own), F.col("row_key").alias(key), F.col("key").alias(source)).agg(
        F.sum("copies").alias(copies), F.count("*").alias(rows))
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    found = docs.join(plan, doc.eqNullSafe(F.col(own)) & (row_key(doc, text) == F.col(key)) & (_key(F.col("source").cast("string")) == F.col(source)))
    turn = F.row_number().over(Window.partitionBy(own, key, source).orderBy(key))
    share = F.floor(F.col(copies) / F.col(rows)) + (turn <= F.col(copies) % F.col(rows)).cast("long")
    found = found.withColumn(each, share).where(F.col(each) > 0)
    return found.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), each))).select(*docs.columns)

"""Intermediate tables in the shared checkpoint folder, and connected components over link tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenflow.session import materialize


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the folder in ``spark.checkpoint.dir``; survives lost executors."""
    return materialize(df)


BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch hold more than ``BATCH_ROWS`` rows: whole texts travel in them, to two workers an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that the table does not have, whatever the case of their letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """A number of a row's id and text: rows that agree in both share it."""
    return F.xxhash64(doc_id, text)


def in_batches(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """Adapter for ``mapInArrow``: applies ``function`` to every batch that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None:
                    yield out
    return run


def connected_components(links: DataFrame, a: str, b: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Smallest node reachable from every linked node: columns ``node`` and ``component`` (both long).

    ``within`` names columns of separate graphs, which lead the result. Alternates large-star and small-star rounds
    until the link table is a forest of stars around the smallest nodes. Links with a null end and links of a node
    with itself are ignored; an empty table gives no rows. Every round is a table in the checkpoint folder; only its
    row count and checksum reach the driver.
    """
    key = list(within)
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    stars = stored(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(*key, high.cast("long").alias("node"), low.cast("long").alias("component")).distinct()
    )
    seen = _checksum(stars)
    while seen[0]:
        both = stars.union(stars.select(*key, F.col("component").alias("node"), F.col("node").alias("component")))
        lowest = both.groupBy(*key, "node").agg(F.min("component").alias("least"))
        lowest = lowest.select(*key, "node", F.least("node", "least").alias("least"))
        larger = both.where(F.col("component") > F.col("node")).join(lowest, [*key, "node"]).select(
            *key, F.col("component").alias("node"), F.col("least").alias("component")
        ).distinct()
        lowest = larger.groupBy(*key, "node").agg(F.min("component").alias("least"))
        smaller = larger.join(lowest, [*key, "node"]).where(F.col("component") != F.col("least")).select(
            *key, F.col("component").alias("node"), F.col("least").alias("component")
        )
        stars = stored(smaller.union(lowest.select(*key, "node", F.col("least").alias("component"))).distinct())
        now = _checksum(stars)
        if now == seen:
            break
        seen = now
    return stars


def _checksum(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns) % 1_000_003)).first()
    return tuple(row)

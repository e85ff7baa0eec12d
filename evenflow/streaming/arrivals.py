"""Arrival gaps and cumulative buffering time of a positioned stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenflow.operators.order import OrderedStream, null_safe_join


def arrival_gaps(stream: OrderedStream, arrival: str) -> DataFrame:
    """(item_number, buffering_time_ms since the first item, interarrival_ms since the previous one)."""
    rows, parts, owned = stream.tiles(1)
    along = Window.partitionBy(*parts).orderBy(stream.pos)
    gaps = rows.withColumn("_previous", F.lag(arrival, 1).over(along)).where(owned)
    firsts = stream.df.groupBy(*stream.keys).agg(F.min_by(arrival, stream.pos).alias("_first"))
    joined = (
        null_safe_join(gaps, firsts, stream.keys) if stream.keys else gaps.crossJoin(F.broadcast(firsts))  # one row
    )

    def since(earlier: str):
        return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(arrival)) / 1000

    return joined.select(
        *stream.keys, (F.col(stream.pos) + 1).alias("item_number"),
        since("_first").alias("buffering_time_ms"),
        F.coalesce(since("_previous"), F.lit(0.0)).alias("interarrival_ms"),
    )


def arrival_summary(gaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation and extremes of the gaps."""
    return gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.avg("interarrival_ms").alias("mean_ms"),
        F.stddev_samp("interarrival_ms").alias("std_ms"), F.min("interarrival_ms").alias("min_ms"),
        F.max("interarrival_ms").alias("max_ms"), F.max("buffering_time_ms").alias("buffering_ms"),
    )

"""Batch sinks for metrics, chunk captures and bounds derivations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from evenflow.operators.bounds import bounds_table


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), file_format: str = "parquet",
                mode: str = "overwrite") -> None:
    """Write a result partitioned by its configuration columns, so a reader can prune to one configuration.

    Overwriting replaces only the partitions that the new rows touch, so a retried or extended run is safe.
    """
    writer = df.write.format(file_format).mode(mode)
    if file_format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def write_metrics(metrics: DataFrame, path: str, config: Sequence[str] = ("window", "block", "landmark"),
                  file_format: str = "parquet") -> None:
    """Run metrics by configuration."""
    write_table(metrics, path, config, file_format)


def write_captures(captures: DataFrame, path: str, config: Sequence[str] = ("window", "block", "landmark"),
                   file_format: str = "parquet") -> None:
    """Original and reordered chunks by configuration and phase."""
    write_table(captures, path, [*config, "phase"], file_format)


def write_bounds(df: DataFrame, attribute: str, block: int, path: str, file_format: str = "csv") -> None:
    """The derivation table of an attribute's bounds."""
    write_table(bounds_table(df, attribute, block).orderBy("category"), path, (), file_format)

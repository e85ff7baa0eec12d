"""Batch sources: CSV with NA tokens, date cleaning, projections, attribute catalogue, chunk files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evenflow.operators.order import ordered_stream
from evenflow.operators.prep import BinModel, fit_adaptive_bins

# Text that means "missing" in a CSV -- the usual dataframe tokens plus a blank and two dashes.
NA_TOKENS = (
    "", " ", "--", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Accepted date layouts. ISO always comes first, so a day-first flag can never swap an ISO date.
ISO_DATES = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
)
DAY_FIRST_DATES = ("d-M-yyyy", "d/M/yyyy", "d-M-yyyy HH:mm", "d/M/yyyy HH:mm")
MONTH_FIRST_DATES = ("M-d-yyyy", "M/d/yyyy", "M-d-yyyy HH:mm", "M/d/yyyy HH:mm")


def read_csv(spark: SparkSession, path: str, schema: StructType, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """CSV with a header; NA tokens become null before the declared types are applied (bad values are null too)."""
    text = StructType([StructField(f.name, StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", True).csv(path)
    return raw.select(*[
        _typed(F.when(~F.coalesce(F.col(f"`{f.name}`"), F.lit("")).isin(*na_tokens), F.col(f"`{f.name}`")), f)
        for f in schema
    ])


def _typed(value: Column, field: StructField) -> Column:
    typed = value if isinstance(field.dataType, StringType) else value.try_cast(field.dataType)
    return typed.alias(field.name)


def parse_date(column: str, day_first: bool = False, formats: Sequence[str] | None = None) -> Column:
    """Timestamp of the first layout that fits, null if none does."""
    if formats is None:
        formats = (*ISO_DATES, *(DAY_FIRST_DATES if day_first else MONTH_FIRST_DATES))
    text = F.trim(F.col(f"`{column}`").cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def clean_dates(df: DataFrame, date_column: str, day_first: bool = False,
                formats: Sequence[str] | None = None) -> tuple[DataFrame, Observation]:
    """Drop rows without a readable date; the observation tells ``total`` and ``kept`` after an action."""
    counts = Observation()
    parsed = df.withColumn(date_column, parse_date(date_column, day_first, formats))
    watched = parsed.observe(counts, F.count(F.lit(1)).alias("total"), F.count(F.col(f"`{date_column}`")).alias("kept"))
    return watched.dropna(subset=[date_column]), counts


def project(df: DataFrame, attribute: str, extra: Sequence[str] = ()) -> DataFrame:
    """The monitored attribute first, then the extra columns; the scan reads nothing else."""
    return df.select(attribute, *[c for c in extra if c != attribute])


def prepare_stream(df: DataFrame, attribute: str, discrete: bool, extra: Sequence[str] = (), max_bins: int = 5,
                   min_share: float = 0.15) -> tuple[DataFrame, str, BinModel | None]:
    """Stream-ready table: a discrete attribute as it is, a continuous one binned (extra columns are kept)."""
    if discrete:
        return project(df, attribute, extra), attribute, None
    model = fit_adaptive_bins(df, attribute, max_bins, min_share)
    binned = f"{attribute}_bin"
    return project(model.transform(df, binned), binned, extra), binned, model


def attribute_catalog(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attribute, rank, value): the distinct values as text in order, one row each, all attributes in one pass."""
    text = df.select(*[F.col(a).cast("string").alias(a) for a in attributes])
    long = text.unpivot([], list(attributes), "attribute", "value").where(F.col("value").isNotNull()).distinct()
    return ordered_stream(long, ["attribute"], ["value"], pos="rank").df.select("attribute", "rank", "value")


def read_chunk_files(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> DataFrame:
    """Chunk CSVs named ``..._s<block>_X...``; the block size comes from the file name, or the read fails."""
    rows = spark.read.schema(schema).option("header", True).csv(paths)
    return rows.withColumn("block", block_size_of(F.input_file_name()))


def block_size_of(name: Column) -> Column:
    """Block size in a configuration name."""
    digits = F.regexp_extract(name, r"_s(\d+)_X", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("no block size in "), name))
    )


def config_name(window: Column, block: Column, landmark: Column, phase: Column) -> Column:
    """Configuration name as the chunk files use it."""
    return F.concat(F.lit("W"), window.cast("string"), F.lit("_s"), block.cast("string"), F.lit("_X"),
                    landmark.cast("string"), F.lit("_"), phase)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Row-wise union by column name."""
    return reduce(DataFrame.unionByName, frames)



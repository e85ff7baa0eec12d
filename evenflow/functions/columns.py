"""Column expressions for categories: clean, recode, bucket, cross, shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(column: str) -> Column:
    """Value as trimmed text."""
    return F.trim(F.col(column).cast("string"))


def recode(value: Column, mapping: Mapping[str, str], default: str) -> Column:
    """Mapped value; anything else, null included, becomes ``default``."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def bucket(value: Column, buckets: Mapping[str, Sequence[str]], otherwise: str | None = None) -> Column:
    """Name of the bucket that lists the value. Without ``otherwise`` an unlisted value raises."""
    if otherwise is None:
        rest = F.raise_error(F.concat(F.lit("value in no bucket: "), F.coalesce(value.cast("string"), F.lit("null"))))
    else:
        rest = F.lit(otherwise)
    arms = [(value.isin(*members), F.lit(name)) for name, members in buckets.items()]
    chain = reduce(lambda case, arm: case.when(*arm), arms[1:], F.when(*arms[0]))
    return chain.otherwise(rest)


def crossed(columns: Sequence[str], separator: str = " | ") -> Column:
    """Intersectional key; null as soon as one part is null."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for part in parts for x in (F.lit(separator), part)][1:])


def shuffle_key(run: Column, *row_id: str) -> Column:
    """Sort key of a reproducible shuffle per run, the same under any partitioning."""
    return F.md5(F.concat_ws(":", run.cast("string"), *[F.col(c).cast("string") for c in row_id]))

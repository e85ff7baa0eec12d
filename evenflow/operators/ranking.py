"""Ranking quality of an order (NDCG) before and after a repair.

Linear gain, discount ``1 / log2(rank + 1)``; the ideal order sorts the same rows by relevance. Groups are
chunks or blocks, so every ranking window is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenflow.operators.order import int_div
from evenflow.operators.stats import paired_summary


def _discounted(relevance: str, rank: Column) -> Column:
    return F.col(relevance) / F.log2(rank + 1)


def ndcg_windows(df: DataFrame, by: Sequence[str], place: str, relevance: str,
                 cutoffs: Sequence[int | None] = (None,)) -> DataFrame:
    """NDCG per group for every cutoff in one pass; null where the ideal gain is zero."""
    ideal = Window.partitionBy(*by).orderBy(F.col(relevance).desc_nulls_last())
    ranked = df.select(*by, relevance, (F.col(place) + 1).alias("_rank"), F.row_number().over(ideal).alias("_ideal"))

    def gain(rank: str, cutoff: int | None) -> Column:
        value = _discounted(relevance, F.col(rank))
        return F.sum(value if cutoff is None else F.when(F.col(rank) <= cutoff, value))

    sums = ranked.groupBy(*by).agg(*[
        x for i, k in enumerate(cutoffs)
        for x in (gain("_rank", k).alias(f"_dcg{i}"), gain("_ideal", k).alias(f"_idcg{i}"))
    ])
    return sums.select(*by, F.inline(F.array(*[
        F.struct(F.lit(k).cast("int").alias("k"),
                 (F.col(f"_dcg{i}") / F.nullif(F.col(f"_idcg{i}"), F.lit(0.0))).alias("ndcg"))
        for i, k in enumerate(cutoffs)
    ])))


def ndcg_blocks(df: DataFrame, by: Sequence[str], place: str, relevance: str, block: int) -> DataFrame:
    """NDCG inside every block; ranks restart at each block."""
    split = df.select(*by, relevance, int_div(place, block).alias("block_index"),
                      (F.col(place) % block).alias("_in_block"))
    return ndcg_windows(split, [*by, "block_index"], "_in_block", relevance).drop("k")


def pair_phases(df: DataFrame, keys: Sequence[str], phase: str = "phase", value: str = "ndcg",
                before: str = "original", after: str = "reordered") -> DataFrame:
    """One row per key with ``orig`` and ``reord``; unpaired or null values are dropped.

    Both phases live in one table, so pairing is an aggregate and not a join.
    """
    sides = df.where(F.col(phase).isin(before, after)).groupBy(*keys).agg(
        F.max(F.when(F.col(phase) == before, F.col(value))).alias("orig"),
        F.max(F.when(F.col(phase) == after, F.col(value))).alias("reord"),
    )
    return sides.dropna(subset=["orig", "reord"])


def ndcg_report(captures: DataFrame, config: Sequence[str], by: Sequence[str], relevance: str, block: int,
                cutoffs: Sequence[int] = (50, 100), place: str = "position_in_chunk") -> DataFrame:
    """Cost of repair per configuration: cutoff at the block size, at fixed ranks, and averaged per block.

    ``config`` columns may name attributes and configurations: all of them are summarised in one job.
    """
    keys = [*config, *by]
    ks = [block, *[k for k in cutoffs if k != block]]
    label = F.when(F.col("k") == block, F.lit("block_size")).otherwise(F.col("k").cast("string"))
    whole = pair_phases(ndcg_windows(captures, [*keys, "phase"], place, relevance, ks), [*keys, "k"]).select(
        *config, label.alias("cutoff"), "k", "orig", "reord"
    )
    blocks = pair_phases(
        ndcg_blocks(captures, [*keys, "phase"], place, relevance, block), [*keys, "block_index"]
    ).select(*config, F.lit("per_block").alias("cutoff"), F.lit(block).alias("k"), "orig", "reord")
    return paired_summary(whole.unionByName(blocks), [*config, "cutoff", "k"], "orig", "reord")

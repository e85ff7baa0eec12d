"""Chat formatting by multi-party perspective rotation.

For every participant the dialogue is rendered with that speaker as the assistant; the others become users that carry
their names, system messages stay. The training mask covers what the perspective's speaker says.

The result has one row per message and perspective with its place in the rendered dialogue, so a dialogue of any
length stays distributed: places are running sums over tiles of turns plus the tiles' offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1024


def rotate_perspectives(turns: DataFrame, tile: int = TILE) -> DataFrame:
    """Rendered messages of every dialogue from every participant's perspective.

    Input columns: conv_id, turn, role (the speaker; ``system`` is no participant), text. Result: conv_id,
    perspective, turn, speaker, role, name, segment (the rendered message), starts (code points before it in the
    rendered dialogue), chars (its length), mask_from and mask_to (trained part of the dialogue, null if not trained).
    A rendered message is ``<|im_start|>role name=speaker\n`` + text + ``<|im_end|>\n``; only named users have a name,
    and the trained part is text and end mark of the assistant.

    A null or blank role is the speaker ``unknown``; a null text is empty; null turns come first; messages of one turn
    are ordered by speaker and text, repeated rows stay. A dialogue of system messages alone has no perspective and
    no rows. Rows with a null conv_id form one dialogue. Other columns are not read.
    """
    speaker = F.when(F.trim("role") == "", None).otherwise(F.trim("role"))
    rows = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(speaker, F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    voices = rows.where("speaker != 'system'").select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    pairs = rows.join(voices, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise("user")
    pairs = pairs.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit("<|im_start|>"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    pairs = pairs.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit("<|im_end|>\n")))
    pairs = pairs.withColumn("chars", F.length("segment")).withColumn("tile", F.floor(F.coalesce("turn", F.lit(-1)) / tile))

    by = ["conv_id", "perspective"]
    tiles = pairs.groupBy(*by, "tile").agg(F.sum("chars").alias("tile_chars"))
    before = Window.partitionBy(*by).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(
        F.col("conv_id").alias("__conv"), F.col("perspective").alias("__voice"), F.col("tile").alias("__tile"),
        F.coalesce(F.sum("tile_chars").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*by, "tile").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = pairs.withColumn("starts", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(
        tiles, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("perspective") == F.col("__voice")) & (F.col("tile") == F.col("__tile")))
    starts = F.col("starts") + F.col("offset")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", "name", "segment", starts.alias("starts"), F.col("chars").cast("long").alias("chars"),
        F.when(F.col("role") == "assistant", starts + F.col("head")).alias("mask_from"),
        F.when(F.col("role") == "assistant", starts + F.col("chars") - 1).alias("mask_to"))


def rendered_dialogues(messages: DataFrame) -> DataFrame:
    """Whole dialogues of ``rotate_perspectives``: conv_id, perspective, text, masks (array of from and to).

    A convenience for dialogues that fit a row; long ones are better used message by message.
    """
    each = F.sort_array(F.collect_list(F.struct("starts", "segment", "mask_from", "mask_to")))
    return messages.groupBy("conv_id", "perspective").agg(each.alias("m")).select(
        "conv_id", "perspective", F.array_join(F.transform("m", lambda x: x["segment"]), "").alias("text"),
        F.filter(F.transform("m", lambda x: F.struct(x["mask_from"].alias("from"), x["mask_to"].alias("to"))), lambda x: x["from"].isNotNull()).alias("masks"))

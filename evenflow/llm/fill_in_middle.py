"""Fill-in-middle transformation: a text is cut into units, and its middle is moved to the end.

One full match of ``(unit)*`` by the regex library keeps every repetition of the group, so ``ends(1)`` gives the number
of units and the place of every border at once; nothing iterates over matches. Python returns the unit count and two
offsets of a text. Choices come from a hash of the id, and texts are put together, and back, by Spark's own functions.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLAIN, PSM, SPM = "plain", "psm", "spm"
CUTS = StructType([StructField(n, LongType()) for n in ("n", "low", "high")])


def _choices(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers from the sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cutter(unit: str):
    import regex

    @F.arrow_udf(CUTS)
    def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        whole = regex.compile(f"({unit})*")
        out = []
        for t, a, b in zip(text, one.to_pylist(), two.to_pylist(), strict=True):
            match = whole.fullmatch(t.as_py() or "")
            if match is None:
                raise ValueError("units must be able to cover every text")
            ends = match.ends(1)
            n = len(ends)
            low, high = sorted((a % (n + 1), b % (n + 1)))
            out.append((n, ends[low - 1] if low else 0, ends[high - 1] if high else 0))
        n, low, high = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, low, high)], names=["n", "low", "high"])
    return cuts


def _check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must show where they stand whatever text lies around them: no end of one begins another."""
    if len(set(marks)) != 3 or not all(marks) or any(a[-k:] == b[:k] for a, b in product(marks, marks) for k in range(1, min(len(a), len(b)))) or any(
            a in b for a, b in product(marks, marks) if a != b):
        raise ValueError("marks must be distinct and must not overlap")


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of every row of ``docs`` (doc_id, text).

    A text is cut into n units, matched left to right. Two borders chosen by the id part it into prefix, middle and
    suffix. ``form`` psm writes prefix, suffix, middle, and spm suffix, prefix, middle, each behind its mark; spm has
    ``spm_rate`` percent of them. plain is the text itself: empty texts, texts that hold a mark, and all but ``rate``
    percent of the rest; its prefix_chars and middle_chars (code points) are null.

    A null text counts as empty; a null doc_id as an empty id. Rows with one id are cut by the same numbers. An empty
    table gives no rows. Other columns are not read. A unit pattern must be able to cover every text, or an error is
    raised; it may hold non-capturing groups only.
    """
    _check_marks(marks)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1, h2, h3, h4 = _choices(F.col("doc_id"), seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), h3.alias("h3"), h4.alias("h4"),
                       _cutter(unit)(text, h1, h2).alias("cut"))
    text, low, high = F.col("text"), F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    marked = F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    form = F.when((text == "") | marked | (F.col("h3") % 100 >= rate), PLAIN).when(F.col("h4") % 100 < spm_rate, SPM).otherwise(PSM)
    rows = rows.withColumn("form", form)
    prefix, middle = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, F.length(text))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == PLAIN, text).when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle)).otherwise(
        F.concat(s, suffix, p, prefix, m, middle))
    there = F.col("form") != PLAIN
    return rows.select("doc_id", "text", F.col("cut.n").alias("n"), "form", F.when(there, F.col("cut.low")).alias("prefix_chars"),
                       F.when(there, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from: its parts between the marks, in their old order."""
    _check_marks(marks)
    p, s, m = marks

    def part(after: str, before: str | None) -> Column:
        begin = F.locate(after, output) + len(after)
        end = F.locate(before, output) if before else F.length(output) + 1
        return F.substring(output, begin, end - begin)

    psm = F.concat(part(p, s), part(m, None), part(s, m))
    spm = F.concat(part(p, m), part(m, None), part(s, p))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)

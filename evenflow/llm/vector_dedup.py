"""Near copies among embeddings by p-stable hashing.

Unit vectors are hashed by quantised Gaussian projections floor((a.v + b) / w); ``hashes`` of them make a bucket of one
table, and there are several tables. Two vectors meet if they share a bucket of any table; whether they link is decided
by their exact cosine in double precision. With the defaults a pair at cosine 0.98 (distance 0.2) shares a bucket with
probability 0.97, closer pairs more surely.

Equal vectors count as one class. A bucket is cut into blocks of bounded size, and every pair of blocks is one work
item, a matrix product. A pair is counted in the first table in which it meets. A work item returns a count per class
and one link per class to the smallest of its local component, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenflow.llm.store import connected_components, in_batches, stored
from evenflow.llm.text import mix

SEED = 977
BLOCK = 512


def _hasher(tables: int, hashes: int, width: float):
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def project(dimension: int) -> tuple[np.ndarray, np.ndarray]:
        if dimension not in planes:
            rng = np.random.default_rng(SEED + dimension)
            planes[dimension] = rng.standard_normal((dimension, tables * hashes)), rng.uniform(0, width, tables * hashes)
        return planes[dimension]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        """(vec_id, label, embedding) -> usable rows with fingerprint, unit vector and buckets."""
        groups: dict[int, list[tuple]] = {}
        for vec, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if vec is None or label is None or not v.is_valid or v.values.null_count:
                continue
            x = np.asarray(v.values, dtype=np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                groups.setdefault(len(x), []).append((vec, label, v.values, x / np.linalg.norm(x)))
        out: list[tuple] = []
        for dimension, rows in groups.items():
            a, b = project(dimension)
            cells = np.floor((np.stack([r[3] for r in rows]) @ a + b) / width).astype(np.int64).view(np.uint64)
            cells = cells.reshape(len(rows), tables, hashes)
            labels = np.array([int.from_bytes(hashlib.blake2b(str(r[1]).encode(), digest_size=8).digest(), "little") for r in rows], dtype=np.uint64)
            key = np.empty((len(rows), tables), dtype=np.uint64)
            for t in range(tables):
                h = mix(labels + np.uint64(dimension * 1000 + t))
                for j in range(hashes):
                    h = mix(h ^ cells[:, t, j])
                key[:, t] = h
            for (vec, label, raw, unit), k in zip(rows, key.view(np.int64), strict=True):
                digest = hashlib.blake2b(np.asarray(raw, dtype=np.float64).tobytes(), digest_size=16).digest()
                out.append((vec, label, digest, unit.tobytes(), k.tolist()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), batch.column(1).type, pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                          names=["vec_id", "label", "print", "unit", "buckets"])
    return in_batches(run)


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _work(threshold: float):
    """Rows sorted by (bucket, low, high) -> (cls, n) counts and (a, b) links."""
    def solve(key: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        x = np.stack([np.frombuffer(r[2], dtype=np.float64) for r in rows])
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        side = np.array([r[4] == key[2] for r in rows])
        if key[1] != key[2]:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        label, ids = local_components(linked), np.array([r[1] for r in rows])
        buckets = np.array([r[3] for r in rows])
        for t in range(rows[0][5]):  # met before
            linked &= buckets[:, t, None] != buckets[None, :, t]
        count = linked @ np.array([r[6] for r in rows], dtype=np.int64)
        hang = np.flatnonzero(label != np.arange(len(label)))
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in some] + [None] * len(hang), pa.int64()), pa.array(count[some].tolist() + [None] * len(hang), pa.int64()),
            pa.array([None] * len(some) + ids[hang].tolist(), pa.int64()), pa.array([None] * len(some) + ids[label[hang]].tolist(), pa.int64()),
        ], names=["cls", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for bucket, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, low, high) != key:
                    if rows and (out := solve(key, rows)) is not None:
                        yield out
                    key, rows = (bucket, low, high), []
                rows.append(tuple(row))
        if rows and (out := solve(key, rows)) is not None:
            yield out
    return run


def vector_groups(vectors: DataFrame, threshold: float = 0.98, tables: int = 12, hashes: int = 16, width: float = 2.0) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding, label).

    Only vectors with equal, non-null labels are compared. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do rows with a null vec_id (their component_id is null and they
    are kept). Vectors of different lengths never link. n_links counts the other rows linked directly, repeated rows
    included; component_id is the smallest vec_id reachable. An empty table gives no rows.
    """
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = ids.schema["label"].dataType.simpleString()
    rows = stored(ids.mapInArrow(
        _hasher(tables, hashes, width), f"vec_id long, label {kind}, print binary, unit binary, buckets array<long>"))
    # Equal vectors: one class, one representative row.
    cls = F.xxhash64(F.col("label").cast("string"), "print")
    rows = rows.withColumn("cls", cls)
    classes = stored(rows.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))

    keys = rows.select("cls", F.posexplode("buckets").alias("t", "bucket")).distinct()
    full = keys.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int")
    placed = keys.join(full, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    one = rows.join(classes.where("copies = 1").select("cls"), "cls", "left_semi").select("cls", "unit", "buckets")
    many = rows.join(classes.where("copies > 1").select("cls"), "cls", "left_semi").groupBy("cls").agg(
        F.min("unit").alias("unit"), F.min("buckets").alias("buckets"))
    items = placed.join(one.union(many).join(classes, "cls"), "cls").select(
        "bucket", "low", "high", "cls", "rep", "unit", "buckets", "own", "t", "copies")
    found = stored(items.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(
        _work(threshold), "cls long, n long, a long, b long"))

    counts = found.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("n"))
    member = rows.select("vec_id", "cls").join(classes, "cls")
    links = found.where("a IS NOT NULL").select("a", "b").union(member.where("vec_id != rep").select("vec_id", "rep"))
    component = connected_components(links, "a", "b").toDF("vec_id", "component")
    # Usable and unusable rows apart: a repeated vec_id may have both.
    used = member.join(counts, "cls", "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    bad = ids.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    return used.union(bad).join(component, "vec_id", "left").select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("vec_id")), F.lit(True)).alias("kept"))


def _usable():
    """The same test as in the hashing pass, as an expression."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))

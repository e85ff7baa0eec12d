"""Registered queries: SQL counterparts on the smallest tables, result columns of the others."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from evenflow.llm.jaccard_join import keep_one_each
from evenflow.llm.line_dedup import without_repeated_lines
from evenflow.llm.mixing import mixed
from evenflow.llm.quality_gam import keep_good
from evenflow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tools.check_oracles import families, rows_of

COLUMNS = {
    "op1_ngram_jaccard_join": {"doc_id": "int", "n_shingles": "int", "component_id": "int"},
    "op2_language_id": {"doc_id": "int", "held_out": "bool", "lang_pred": "text", "score": "float"},
    "op3_warc": {"page_id": "int", "payload_bytes": "int", "payload_digest": "text", "record_type": "text", "refers_to": "int"},
    "op4_mixing": {"doc_id": "int", "size": "int", "source_size": "int", "target": "float", "taken": "int"},
    "op5_quality_classifier": {"doc_id": "int", "held_out": "bool", "score": "float", "predicted": "int"},
    "op7_embedding_near_dedup": {"vec_id": "int", "n_links": "int", "component_id": "int", "kept": "bool"},
    "op9_quality_rules": {"doc_id": "int", "n_words": "int", "word_chars": "int", "n_symbols": "int", "n_dup_lines": "int",
                          "n_repeat_words": "int", "base_failed": "bool", "kept": "bool"},
    "op11_centroid_clustering": {"vec_id": "int", "cluster": "int", "distance": "int", "cluster_inertia": "int", "inertia": "int",
                                 "centroid_sha256": "text"},
    "op12_substring_dedup": {"doc_id": "int", "n_words": "int", "n_removed": "int", "kept_sha256": "text"},
    "op13_fill_in_middle": {"doc_id": "int", "n": "int", "form": "text", "prefix_chars": "int", "middle_chars": "int", "output_sha256": "text",
                            "restored_sha256": "text"},
    "op10_packing": {"doc_id": "int", "start": "int", "length": "int", "ids_crc32": "int", "doc_tokens": "int", "sequence_id": "int",
                     "offset": "int"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert families(got.dtypes) == families(zip(names, [str(d[1]) for d in cursor.description], strict=True))
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    got = QUERIES[name](spark, SF)
    assert families(got.dtypes) == COLUMNS[name]
    assert got.count() > 0


NAMES = ["id", "row_key", "gone", "counts", "score", "copies", "rows", "each", "source_key", "removed", "n_shingles", "__counts", "__score", "__id",
         "__words", "__each", "__gone"]


@pytest.mark.parametrize("keep", [
    lambda d, labels: keep_good(d, labels, threshold=0.0), lambda d, _: without_repeated_lines(d), lambda d, _: mixed(d), lambda d, _: keep_one_each(d)],
    ids=["keep_good", "without_repeated_lines", "mixed", "keep_one_each"])
def test_rows_and_columns_stay(spark, keep):
    """Null and huge ids, one id with two texts, and tables that hold the names in use."""
    texts = [(2 ** 60 + 1, "a first text with words of its own"), (None, "no id but some text here"), (5, "quite another text in this row"),
             (5, "the same id and yet a second one"), (7, None), (2 ** 60, "numbers next to each other stay apart")]
    rows = [(i, t, "en", "s", *(f"{n}-{k}" for n in NAMES)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES)
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, schema).repartition(3)
    got = keep(table, labels)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_one_id_with_two_texts_is_two_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    table = spark.createDataFrame([(3, a), (2, a + " more"), (3, b), (9, b + " end"), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, keep_one_each(table).collect())) == [(2, a + " more"), (3, b)]
    lines = spark.createDataFrame([(1, "x y z"), (2, "x y z\nu v"), (2, "q r\ns t")], "doc_id long, text string")
    assert sorted(map(tuple, without_repeated_lines(lines).collect())) == [(1, "x y z"), (2, "q r\ns t"), (2, "u v")]

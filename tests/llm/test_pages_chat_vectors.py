"""WARC round trip, chat perspectives, vector near copies."""

from __future__ import annotations

import base64
import gzip
import hashlib

import numpy as np
import pytest

from evenflow.llm.chat import rendered_dialogues, rotate_perspectives
from evenflow.llm.vector_dedup import local_components, vector_groups
from evenflow.llm.warc import assemble_captures, capture_digests, read_records, records, round_trip, write_archives

PAGES = "page_id long, url string, html string, digest string"


def pages():
    htmls = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n\r\n", "x" * 400_000, "<p>a</p>", "\x00\x01", "<p>b</p>"]
    rows = [(i + 1, f"http://e.org/{i}", h, "clash") for i, h in enumerate(htmls)]
    return rows + [(50, None, "<p>b</p>", ""), (51, "bad url\r\nX: y", "<p>c</p>", ""), (2, "http://e.org/1", "<p>a</p>", "clash"), (None, "u", "<p>z</p>", "")]


def expected(rows, least=0):
    bodies = [(r[0], (r[2] or "").encode()) for r in rows]
    first = {}
    for p, b in bodies:
        if p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, b in bodies:
        again = len(b) >= least and p is not None and p != first[b]
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = round_trip(df, f"{tmp_path}/warc", least)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(rows, least)


def test_archives_and_captures(spark, tmp_path):
    rows = pages()
    write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/warc")
    files = list((tmp_path / "warc").glob("part-*.gz"))
    raw = [x for f in files for x in records(gzip.decompress(f.read_bytes()))]
    assert len(raw) == 3 * len(rows)
    assert all(int(h["content-length"]) == len(b) for h, b in raw)
    captures = assemble_captures(read_records(spark, f"{tmp_path}/warc")).collect()
    assert len(captures) == len(rows)
    for c in captures:
        assert c.request.target_uri == c.response.target_uri == c.metadata.target_uri
        assert c.response.record_id == c.capture_id
    wanted = {(r[2] or "").encode() for r in rows}
    assert {bytes(c.response.block).partition(b"\r\n\r\n")[2] for c in captures if c.response.type == "response"} == wanted


def test_no_pages(spark, tmp_path):
    assert round_trip(spark.createDataFrame([], PAGES), f"{tmp_path}/warc").count() == 0


def test_parts_that_are_missing(spark):
    schema = ("type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, header_digest string, "
              "payload_bytes long, payload_digest string, block binary")
    rows = [("request", "r1", "c1", None, None, None, None, 0, None, None), ("response", "c2", None, None, None, None, None, 3, "D", None),
            ("metadata", "m", None, None, None, None, None, 0, None, None), ("response", None, None, None, None, None, None, 0, None, None)]
    got = {r.capture_id: r for r in assemble_captures(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"c1", "c2", "m"}
    assert got["c1"].response is None and got["c2"].request is None and got["m"].metadata.record_id == "m"
    assert {r.payload_digest for r in capture_digests(assemble_captures(spark.createDataFrame(rows, schema))).collect()} == {"D"}


# -- chat ------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, name string"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind", "?"), (1, 1, "ann", "hi", "?"), (1, 2, "bob", None, "?"), (1, 3, "ann", "bye", "?"), (1, 3, "ann", "bye", "?"),
            (2, 0, "system", "alone", "?"), (None, None, " ", "lost", "?"), (3, 2000, "cy", "late", "?"), (3, 0, "dee", "é", "?")]
    messages = rotate_perspectives(spark.createDataFrame(rows, TURNS), tile=2)
    whole = {(r.conv_id, r.perspective): r for r in rendered_dialogues(messages).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "cy"), (3, "dee")}
    ann = whole[1, "ann"]
    assert ann.text == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
                        "<|im_start|>assistant\nbye<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n")
    assert [ann.text[m["from"]:m["to"]] for m in ann.masks] == ["hi<|im_end|>", "bye<|im_end|>", "bye<|im_end|>"]
    bob = whole[1, "bob"]
    assert [bob.text[m["from"]:m["to"]] for m in bob.masks] == ["<|im_end|>"]
    assert whole[3, "cy"].text == "<|im_start|>user name=dee\né<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"
    for r in messages.collect():
        text = whole[r.conv_id, r.perspective].text
        assert text[r.starts:r.starts + r.chars] == r.segment
    assert rotate_perspectives(spark.createDataFrame([], TURNS)).count() == 0


# -- vectors ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, kept string"


def test_vector_groups(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((30, 24))
    for i in range(300):
        v = base[i % 30] + rng.standard_normal(24) * rng.choice([0, 0.02, 0.12, 0.2])
        rows.append((i, [float(x) for x in (v * rng.choice([1, 3])).astype(np.float32)], int(i % 30 % 4), "x"))
    rows += [(400, None, 1, ""), (401, [0.0] * 24, 1, ""), (402, [float("nan")] * 24, 1, ""), (403, [None] * 24, 1, ""), (404, [float("inf")] + [1.0] * 23, 1, ""),
             (405, rows[0][1], None, ""), (406, [], 1, ""), (407, rows[0][1][:12], 0, ""), rows[7], (None, rows[0][1], 0, "")]
    got = vector_groups(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    good = [r for r in rows if r[0] is not None and r[0] < 400]
    x = np.array([r[1] for r in good], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    links = {r[0]: int(n) for r, n in zip(good, linked.sum(axis=1), strict=True)}
    found = {r.vec_id: r for r in got}
    assert sum(found[v].n_links for v in links) >= 0.97 * sum(links.values())
    assert all(found[v].n_links <= n for v, n in links.items())
    comp = local_components(linked)
    same = sum(found[good[i][0]].component_id == good[comp[i]][0] for i in range(len(good)))
    assert same >= 0.97 * len(good)
    for r in got:
        if r.vec_id is None or r.vec_id >= 400:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.kept == (r.vec_id == r.component_id)
    assert vector_groups(spark.createDataFrame([], VECTORS)).count() == 0



"""Registered queries of the training-data operators: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenflow.llm.chat import rotate_perspectives
from evenflow.llm.decision_list import quality_rules
from evenflow.llm.fill_in_middle import fill_in_middle, restored
from evenflow.llm.jaccard_join import jaccard_groups
from evenflow.llm.language_id import identify_languages
from evenflow.llm.line_dedup import without_repeated_lines
from evenflow.llm.mixing import mix_plan
from evenflow.llm.packing import pack
from evenflow.llm.quality_gam import quality_scores
from evenflow.llm.simplex_clusters import simplex_clusters
from evenflow.llm.store import bound_batches
from evenflow.llm.substring_dedup import without_repeated_passages
from evenflow.llm.vector_dedup import vector_groups
from evenflow.llm.warc import round_trip
from evenflow.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return function(spark, folder)
    QUERIES[function.__name__] = run
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark, folder):
    return jaccard_groups(table(spark, folder, "documents"), k=4, percent=85)


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


@query
def op2_language_id(spark, folder):
    return identify_languages(table(spark, folder, "documents"))


@query
def op3_warc(spark, folder):
    archives = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    return round_trip(table(spark, folder, "pages"), archives)


ORACLES["op3_warc"] = """
WITH bodies AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
  SELECT page_id, payload_bytes,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
             (CAST('0x' || substr(h, 10 * (d // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (d % 8))) & 31) AS INTEGER), 1)
           FOR d IN range(0, 32)], '') AS payload_digest
  FROM bodies
), firsts AS (SELECT payload_digest, payload_bytes, min(page_id) AS first_id FROM digests GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM digests JOIN firsts USING (payload_digest, payload_bytes)
"""


@query
def op5_quality_classifier(spark, folder):
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_chat_formatting(spark, folder):
    return rotate_perspectives(table(spark, folder, "conversations"))


ORACLES["op6_chat_formatting"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), voices AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
pairs AS (
  SELECT s.*, perspective,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM said s JOIN voices v ON s.conv_id IS NOT DISTINCT FROM v.conv_id
), heads AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM pairs
), cut AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, CAST(length(segment) AS BIGINT) AS chars,
         CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts
  FROM cut
)
SELECT conv_id, perspective, turn, speaker, role, name, segment, starts, chars,
       CASE WHEN role = 'assistant' THEN starts + length(head) END AS mask_from,
       CASE WHEN role = 'assistant' THEN starts + chars - 1 END AS mask_to
FROM placed
"""


@query
def op9_quality_rules(spark, folder):
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_mixing(spark, folder):
    return mix_plan(table(spark, folder, "documents")).drop("source", "copies")


@query
def op7_embedding_near_dedup(spark, folder):
    return vector_groups(table(spark, folder, "embeddings"))


@query
def op10_packing(spark, folder):
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    cleaned = without_repeated_lines(docs.withColumn("n_lines", lines), removed="gone")
    return cleaned.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed_lines"), "text")


ORACLES["op8_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line FROM split),
bags AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x20\x09-\x0D]+'))) AS s FROM lines
), sets AS (SELECT *, len(s) AS n, row_number() OVER (ORDER BY doc_id, line) AS k FROM bags WHERE len(s) >= 1),
words AS (SELECT k, n, unnest(s) AS w FROM sets),
df AS (SELECT w, count(*) AS c FROM words GROUP BY w),
placed AS (SELECT k, n, w, row_number() OVER (PARTITION BY k ORDER BY c, w) AS p FROM words JOIN df USING (w)),
prefix AS (SELECT k, n, w FROM placed WHERE p <= n - CAST(ceil(80 * n / 100.0) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.k AS a, b.k AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.k < b.k
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), gone AS (
  SELECT DISTINCT y.doc_id, y.line FROM pairs JOIN sets x ON x.k = a JOIN sets y ON y.k = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
)
SELECT s.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed_lines,
       CASE WHEN g.n IS NULL THEN array_to_string(ls, chr(10)) ELSE coalesce(g2.kept, '') END AS text
FROM split s
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id) g ON g.doc_id = s.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(t, chr(10) ORDER BY l.line) AS kept FROM lines l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line
           GROUP BY l.doc_id) g2 ON g2.doc_id = s.doc_id
"""


@query
def op11_centroid_clustering(spark, folder):
    return simplex_clusters(table(spark, folder, "embeddings"))


def _clustering_sql(rounds: int = 3) -> str:
    """The rounds of integer k-means, one after the other."""
    square = "list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, 65)])"
    steps = [f"""near{r} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS d, arg_min(k, d * 16 + k) AS k
  FROM (SELECT v.r, v.vec_id, v.x, c.k, CAST({square} AS BIGINT) AS d FROM vectors v, centroids{r} c) GROUP BY r
)""" for r in range(rounds + 1)]
    moves = [f"""sums{r} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM near{r}, range(1, 65) t(i) GROUP BY k, i),
means{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{r} GROUP BY k),
centroids{r + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM centroids{r} c LEFT JOIN means{r} m ON m.k = c.k)""" for r in range(rounds)]
    chain = [s for r in range(rounds) for s in (steps[r], moves[r])] + [steps[rounds]]
    return f"""
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS r, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([1 FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64
), centroids0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k, x FROM vectors QUALIFY k < 16
), {", ".join(chain)}
SELECT vec_id, CAST(n.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near{rounds} n JOIN centroids{rounds} c ON c.k = n.k
"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()


@query
def op12_substring_dedup(spark, folder):
    return without_repeated_passages(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_substring_dedup"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS words FROM texts, range(1, len(w) - 33) t(i)),
found AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY words) > 1),
gone AS (SELECT DISTINCT r, i + o AS i FROM found, range(35) t(o)),
places AS (SELECT r, i, w[i] AS word FROM texts, range(1, len(w) + 1) t(i)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM places ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


@query
def op13_fill_in_middle(spark, folder):
    rows = fill_in_middle(table(spark, folder, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce(regexp_extract_all(text, '[^
]*
|[^
]+'), []) AS u FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts
), parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:n], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

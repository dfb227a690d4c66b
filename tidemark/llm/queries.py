"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .chat import CONTROL, chat_digests, format_chat, marked_conversation
from .clusters import K, ROUNDS, centroid_clusters
from .common import UPPER, table
from .embed_dedup import COSINE, near_duplicate_vectors
from .exact_dedup import exact_dedup
from .langid import language_id
from .lattice import encode
from .mixing import plan_mix
from .negatives import hard_negatives
from .secrets import scan_secrets
from .simhash import near_duplicates
from .token_files import read_tokens, write_tokens
from .warc import LEAST, read_bundles, write_bundles


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Per document: the number of its pieces, the CRC-32 of their ids in decimal and joined by commas, and the digest of the text they decode to."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    read = encode(table(spark, sf_dir, "documents"), model, decoded=True)
    listed = F.btrim(F.to_json("pieces"), F.lit("[]"))  # ids in decimal, joined by commas
    return read.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.crc32(listed.cast("binary")).alias("pieces_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chat(turns.unionByName(marked_conversation(spark))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_bundles(write_bundles(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), "id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '&', '&amp;')"
    for m in CONTROL:
        x = f"replace({x}, '{m}', '{ {'<': '&lt;', '[': '&lsqb;'}[m[0]] + m[1:] }')"
    return x


_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _lloyd_sql() -> str:
    """Rounds written out: a<t> assigns with the centroids c<t>; a distance and a number in one integer take the nearest and the smaller number."""
    parts = [
        f"""WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS i, vec_id, {_WHOLE} AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT {K})"""
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
            SELECT v.i, min(CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) * 64 + m.c) AS key FROM v, c{t} m GROUP BY v.i)""")
        if t < ROUNDS:
            parts.append(f"""s{t} AS (
            SELECT a.key % 64 AS c, p.k, sum(v.x[p.k]) AS total, count(*) AS n FROM a{t} a JOIN v USING (i), range(1, 65) p(k) GROUP BY ALL),
        c{t + 1} AS MATERIALIZED (
            SELECT m.c, coalesce(n.x, m.x) AS x FROM c{t} m LEFT JOIN (
                SELECT c, list(CAST((total - (total % n + n) % n) // n AS BIGINT) ORDER BY k) AS x FROM s{t} GROUP BY c) n ON n.c = m.c)""")
    return ",\n        ".join(parts) + f"""
        SELECT v.vec_id, CAST(a.key % 64 AS INT) AS cluster, CAST(a.key // 64 AS BIGINT) AS distance,
            CAST(sum(a.key // 64) OVER (PARTITION BY a.key % 64) AS BIGINT) AS cluster_inertia, CAST(sum(a.key // 64) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(m.x, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN v USING (i) JOIN c{ROUNDS} m ON m.c = a.key % 64"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op8_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t),
        e AS (
            SELECT *, length({_sql_escape('text')}) + CASE
                WHEN before = role THEN 3
                ELSE 4 + length(replace({_sql_escape('role')}, chr(10), '&#10;')) + CASE WHEN before IS NULL THEN 0 ELSE 4 END END AS chars
            FROM m)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) + 4 AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM g""",
    "op11_centroid_clusters": _lloyd_sql(),
    "op12_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
        reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
        SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
        FROM reached r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = r.a GROUP BY r.a""",
    "op13_hard_negatives": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS x FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS MATERIALIZED (
            SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
        SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10""",
}

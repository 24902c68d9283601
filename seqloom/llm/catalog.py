"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import alignment, hnsw, langid, lm, media, mixing, neardup, negatives, pieces, secrets, substrings, tokencount, warc
from seqloom.llm.common import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.classes(table(spark, sf_dir, "embeddings"), least=0.93)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.remainder("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenized(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids", "exact", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(media.store_media(table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.deduplicated(table(spark, sf_dir, "documents"), window=13))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), every=10)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return negatives.mine(moved, F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


SQL = {
    "op1_hnsw": """
        WITH RECURSIVE x AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        e AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        r(v, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v),
        c AS (SELECT v, min(m) AS component_id FROM r GROUP BY v),
        d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON v = vec_id LEFT JOIN d ON a = vec_id
    """,
    "op4_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM w),
        n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
        x AS (SELECT doc_id, unnest(s) AS e FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (
            SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * i >= 85 * (na.n_shingles + nb.n_shingles - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(v, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v),
        c AS (SELECT v, min(m) AS component_id FROM r GROUP BY v)
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON v = doc_id
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM q
    """,
    "op7_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS t FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM s),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g WHERE least < doc_id),
        x AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS k FROM d),
        k AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY k) AS t FROM x ANTI JOIN r USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op11_negatives": """
        WITH x AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
        n AS (
            SELECT p.a, p.b, p.score, s.b AS n, s.score AS t FROM p JOIN s ON p.a = s.a AND NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT a AS anchor_id, b AS positive_id, (row_number() OVER w)::INTEGER AS rank, n AS negative_id, score AS positive_score, t AS negative_score
        FROM n WINDOW w AS (PARTITION BY a, b ORDER BY t DESC, n) QUALIFY rank <= 5
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_hnsw, op2_langid, op3_sentencepiece, op4_minhash, op5_media, op6_warc, op7_substrings, op8_secrets, op9_lm, op10_mixing, op11_negatives, op12_alignment, op13_tokencount)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

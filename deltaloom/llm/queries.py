"""The registered queries of the training-data operators, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_tools, decontaminate, html_mincut, language_rank, ngram_join, pivot_search, sentencepiece_codec, token_planes, toxicity, warc_bundles
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), k=5, query_modulus=50, scale=256.0)


def op4_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.format_chats(table(spark, sf_dir, "conversations"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), width=5, percent=75)


def op6_language_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_rank.train_profiles(docs.where(~language_rank.held_out(F.col("doc_id"))))
    return language_rank.identify(docs, profiles).select("doc_id", F.coalesce(language_rank.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive_and_read(table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~language_rank.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(language_rank.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_sentencepiece, op3_pivot_topk, op4_chat_tools, op5_ngram_join, op6_language_rank, op7_warc, op8_html_mincut, op9_token_planes, op10_toxicity)} | {"pipeline": pipeline}

ORACLES = {
    "op3_pivot_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
            FROM v q JOIN v x ON x.vec_id <> q.vec_id AND len(x.e) = len(q.e) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op5_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
        n AS (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
        sets AS (SELECT s, min(r) AS r, min(doc_id) AS doc_id, any_value(len(s)) AS n FROM (SELECT r, doc_id, list_sort(s) AS s FROM s WHERE doc_id IS NOT NULL) GROUP BY s),
        e AS (SELECT r, n, unnest(s) AS g FROM sets),
        pairs AS (
            SELECT a.r AS u, b.r AS v FROM e a JOIN e b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
            GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        links AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
        reach AS (SELECT r AS u, r AS v FROM sets UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
        least AS (SELECT reach.u AS r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.v GROUP BY reach.u),
        named AS (SELECT s.r, least.component_id FROM s JOIN sets ON list_sort(s.s) = sets.s JOIN least ON least.r = sets.r WHERE s.doc_id IS NOT NULL)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(named.component_id, w.doc_id) AS component_id
        FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN named ON named.r = w.r""",
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS html FROM pages),
        h AS (SELECT page_id, octet_length(html) AS size, sha1(html) AS sha FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS least FROM h)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(sha, CAST(10 * (j // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > least THEN least END AS refers_to
        FROM f""",
}

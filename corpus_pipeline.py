"""A corpus pipeline: language ID, toxicity, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's
result into the shared folder and reads it back as the next one's documents.

All stages but the last return the columns of documents and ignore others, whatever their
names; an empty table gives an empty one. Ids may be null or repeat: stages decide by row
(id and text together), and rows that repeat both share one decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import decontaminate, language_rank, ngram_join, sentencepiece_codec, toxicity
from deltaloom.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a 64-bit key ``row`` of id and text: stages decide by row, as ids may be null or repeat."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def _without(keyed: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The documents whose key isn't among ``rows``.

    The keys are written first, so Spark knows their size and shuffles the texts only if
    there are too many keys to broadcast.
    """
    return keyed.join(materialise(rows.distinct(), name), "row", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null or empty texts, or no letter in it.

    Where no row has both a text and a language nothing is learned, and all go. Rows that
    repeat stay as often as they are; of languages at one distance the first by name counts.
    """
    profiles = language_rank.train_profiles(docs.where(~language_rank.held_out(F.col("doc_id"))))
    found = language_rank.identify(docs, profiles, carry=COLUMNS)
    return found.where(F.col("lang_pred") != language_rank.UNDETERMINED).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model marks.

    Null and empty texts are scored as texts without words; without usable labels nothing is
    marked. Rows that repeat stay as often as they are.
    """
    labels = table(spark, sf_dir, "labels").where(~language_rank.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of linked documents, the one with the smallest id.

    Rows of one id with different texts are documents of their own; of rows that repeat an
    id and a text one stays. Documents without an id link with nothing and stay, as do
    those without words (but rows that repeat an id and a null or empty text stay once).
    """
    keyed = _keyed(docs)
    ids = materialise(keyed.where("doc_id is not null").select("row", "doc_id"), "ids")
    found = ngram_join.link_components(keyed.withColumn("id", F.expr("if(doc_id is null, null, row)")), width=5, percent=75, id_col="id")
    groups = found.where("doc_id is not null").selectExpr("doc_id AS row", "component_id").distinct()
    named = materialise(groups.join(ids, "row").select("row", "doc_id", "component_id"), "groups")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    kept = _without(keyed, named.select("row").join(first, "row", "left_anti"), "copies")
    again = materialise(ids.groupBy("row").count().where("count > 1").select("row"), "repeated")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    rows = kept.join(again, "row", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "row", "left_anti").select(*COLUMNS).union(rows)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and items hold nothing. Rows that share an id with a document that
    goes stay if their text is another.
    """
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="row")
    return _without(keyed, found.select(F.col("doc_id").alias("row")), "contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left; null texts count as empty, null ids stay null."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", unique), ("decontamination", decontaminated), ("tokens", tokens)]

#: SQL expresses none of the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

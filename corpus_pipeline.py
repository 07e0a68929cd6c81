"""A corpus pipeline over ``documents``: quality, language, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.llm import decontaminate, jaccard, language, packing, quality
from clipweave.llm.common import folded, labels, saved, unused, without
from clipweave.llm.queries import tokenizer

#: A document stays with at least this quality score, and if the mean probability of its language is at least this part of the way from chance to certainty.
QUALITY, LANGUAGE = 0.3, 0.25


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from labelled rows outside the held-out fold. All columns, repeated rows and null ids are kept; null and empty texts have the score of an empty text."""
    held = folded("doc_id") % 5 == 0
    model = quality.fit_quality(docs, labels(spark, sf_dir).where(~held))
    score = unused(docs, "quality_score")
    return quality.quality_scores(docs, model, out=score).where(F.col(score) >= QUALITY).drop(score)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are, for the most part, in one language that the field knows; it learns from rows with a language outside the held-out fold.

    Null texts and texts without letters go; all columns, repeated rows and null ids are kept. Without anything to learn from, nothing is rejected.
    """
    model = language.fit_language(docs.where((folded("doc_id") % 3 != 1) & F.col("doc_id").isNotNull()))
    if not model.languages:  # nothing to learn from, nothing to reject by
        return docs
    out = unused(docs, "lang", ("_pred", "_score"))
    pred, score = f"{out}_pred", f"{out}_score"
    least = 1 / len(model.languages) + LANGUAGE * (1 - 1 / len(model.languages))
    return language.tag_languages(docs, model, out=out).where((F.col(pred) != language.UNKNOWN) & (F.col(score) >= least)).drop(pred, score)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates; of rows that repeat it, one; rows without an id or shingle stay."""
    groups = jaccard.near_duplicates(docs)
    kept = without(docs, groups.where("component_id < doc_id").select("doc_id"))
    twice = saved(kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if not twice.limit(1).count():
        return kept
    return without(kept, twice).unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null texts and ids stay, all columns and repeated rows are kept."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens, packed: the pieces with their places and ids. A null text is its end token; repeated rows are documents of their own."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Fitted scores and tokenizer ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs

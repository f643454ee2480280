"""A training-corpus pipeline over ``documents``: each stage works on all that the one before it kept.

1. documents that the quality classifier rejects go;
2. of equal texts the one with the largest id stays;
3. of each group of near-duplicates (four-word shingles, Jaccard 0.85) the one with the smallest id stays;
4. documents contaminated with benchmark passages go;
5. the rest is sampled to target shares of source, language and topic.

All but the last stage return the columns of ``documents``; the last adds the sampling figures (topic,
tokens, multiplier, copies; under a name with ``mix_`` before it where the documents have that column).
Stages read ids as the documents' keys; a document without id is judged by its own text where the
stage can, and kept otherwise. Rows that share an id are mixed each by its own text, source and
language. Texts are read whole, however long. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cradlemart.llm import mixing
from cradlemart.llm.common import stored, table
from cradlemart.llm.decontaminate import find_contamination, is_contaminated
from cradlemart.llm.exact_dedup import deduplicate
from cradlemart.llm.jaccard_join import similar_documents
from cradlemart.llm.quality import accepted


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids`` (id); null ids stay."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, similar_documents(docs).where("component_id <> id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, find_contamination(docs, table(spark, sf_dir, "benchmark")).where(is_contaminated()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = F.xxhash64("text", "source", "lang")  # tells rows of one id apart
    mixed = mixing.mix_sources(docs, also={"_mark": mark}).where("copies > 0").select(
        F.col("id").alias("_id"), "_mark", "topic", "tokens", F.round("multiplier", 6).alias("multiplier"), "copies"
    ).dropDuplicates(["_id", "_mark"])
    for name in ("topic", "tokens", "multiplier", "copies"):
        mixed = mixed.withColumnRenamed(name, _free(name, docs.columns))
    return docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["_id"]) & (mark == mixed["_mark"])).drop("_id", "_mark")


def _free(name: str, taken: list[str]) -> str:
    """A name for an added column that the documents do not have yet."""
    while name.lower() in (c.lower() for c in taken):
        name = f"mix_{name}"
    return name


STAGES = [
    ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
    ("mix", mix),
]
ORACLE_SQL = None  # the classifier and the mixing of its output cannot be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

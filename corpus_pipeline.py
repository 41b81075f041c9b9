"""A training corpus from documents in five stages, each written as Parquet and read again as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out of the texts,
documents that hold benchmark passages go, and the rest gets the rates at which it meets the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minhash, mixture, substrings, toxicity
from tessera.llm.common import cut, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids of `gone`; rows without doc_id stay. The same join at every size."""
    return docs.join(gone.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=[c for c in docs.columns if c != "doc_id"])
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates."""
    return _without(docs, minhash.near_duplicates(docs).filter("not kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; words in windows that start earlier elsewhere are cut out, other texts stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = substrings.strip_repeats(docs, carry=[*others, "text", "n_chars"], with_text=True)
    changed = F.col("n_removed") > 0
    return found.select(*(F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias(c) if c == "text" else F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _without(docs, decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark")))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and n_tokens, domain and rate of each; documents that the mixture has no use for go."""
    labels = read_table(spark, sf_dir, "labels")
    mixed = mixture.mix(docs, mixture.language_and_quality(docs, labels), mixture.TARGETS).select(F.col("doc_id").alias("mixed_id"), "n_tokens", "domain", "rate")
    both = docs.join(mixed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("mixed_id")))
    return both.filter("rate > 0").select(*docs.columns, "n_tokens", "domain", "rate")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixture", weigh),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is in the shared folder before the next one starts."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The stages learn classifiers and iterate; SQL can't express them. tests/llm compares them with brute force.
ORACLE_SQL = None

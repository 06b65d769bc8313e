"""A corpus pipeline of the training-data operators: quality, near-dedup, suffix dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to the documents
table, each stage's result being written to the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import decontaminate, mixing, near_dedup, quality, suffix_dedup
from linkwright.llm.frames import durable, release

#: Near-duplicates share 80 hundredths of their word shingles (op7's own contract has 85).
SHARE = 80


def apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], made: Iterable[str]) -> DataFrame:
    """operator(docs), where columns of docs that are named as one that the operator makes are put by meanwhile."""
    names = {c: f"_own_{c}" for c in made if c in docs.columns}
    return operator(docs.withColumnsRenamed(names))


def restored(docs: DataFrame, out: DataFrame) -> DataFrame:
    """out with the columns of docs alone, under their own names."""
    return out.select(*[F.col(f"_own_{c}" if f"_own_{c}" in out.columns else c).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = apart(docs, lambda d: quality.score_quality(d, labels), ("held_out", "score", "predicted"))
    return restored(docs, scored.where("predicted = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, at the threshold of the stages on word shingles."""
    kept = near_dedup.near_duplicates(docs, share=SHARE).where("kept and doc_id is not null").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    return out.select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of which nothing is left go."""
    cut = apart(docs, suffix_dedup.suffix_dedup, suffix_dedup.RESULT.names).where("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return restored(docs, cut)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("near_dedup", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The classifier, the suffix arrays and the cube method have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

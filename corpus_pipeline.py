"""The corpus pipeline over documents: filter, rank, drop near-copies, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again before the next one. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import nearcopies, packing, quality, substrings, toxicity
from tessella.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    return toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels")).where("score < 0.3").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under 0.5 go."""
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).where("score >= 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 on 5-word shingles the one of least id stays; documents without an id stay."""
    first = nearcopies.first_of_groups(docs)
    kept = docs.withColumn("text_hash", F.xxhash64("text")).join(first, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return kept.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id has go; n_chars follows. Every document stays, with what text is left."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: Trained models have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

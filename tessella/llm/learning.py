"""What both classifiers share: folds, bounded samples of labelled documents, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import materialise, slices


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_label: int, text: str = "text", doc_id: str = "doc_id", longest: int = 200_000) -> DataFrame:
    """(text, label): up to per_label documents of each label from the fold, those of least hash.

    Of rows that share an id the least text counts; texts over `longest` characters aren't learnt from.
    These parameters bound what is joined by broadcast and trained on, in rows and in bytes.
    """
    known = labels.where(F.col(label).isin(0, 1) & fold).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    parts = [known.where(F.col("_label") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(per_label) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1]).withColumnRenamed(doc_id, "_id")
    mine = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where(F.col(text).isNull() | (F.length(text) <= longest))
    return mine.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.min("text").alias("text")).select("text", F.col("_label").alias("label"))


def labelled_scores(docs: DataFrame, labels: DataFrame, label: str, fold: Column, scores: Callable[[list], object], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_label, score) of every labelled document of the fold; of rows that share an id the least score counts.

    Texts are scored where they lie; only ids, labels and scores are shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & fold).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    mine = docs.where(F.col(doc_id).isNotNull() & fold).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    scored = score(mine, lambda: scores).groupBy("_id").agg(F.min("score").alias("score"))
    return materialise(scored.join(known, "_id").select("_label", "score"), "labelled-scores")


def nth_least(df: DataFrame, col: str, n: int) -> float:
    """The n-th least (from 0) of a column of finite doubles, exactly.

    Four rounds count the values by 16 more bits each, so that what reaches the driver is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (b.column(0).to_numpy() + 0.0).view(np.int64)
            yield pa.RecordBatch.from_pydict({"bits": x ^ ((x >> 63) & np.int64(2**63 - 1))})  # in the order of the doubles

    left = df.select(col).mapInArrow(run, "bits long")
    for shift in (48, 32, 16, 0):
        part = F.shiftright("bits", shift)
        for value, count in sorted(left.groupBy(part).count().collect()):
            if n < count:
                break
            n -= count
        left = left.where(part == value)
    x = np.array([value])
    return float((x ^ ((x >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def score(df: DataFrame, model: Callable[[], Callable[[list], object]], text: str = "text", out: str = "score") -> DataFrame:
    """Adds a score (double) to each row; a column of that name is replaced. No shuffle.

    model() gives, in the worker, the function from a list of texts to their scores.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model()
        for batch in slices(batches):
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(scores(batch.column(text).to_pylist()), pa.float64())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def judged(df: DataFrame, mod: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return df.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

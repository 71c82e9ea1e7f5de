"""Operator 7: best-fit packing, planned over a histogram of lengths."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import materialise, slices, table

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048


class WordIds:
    """Ids of texts under a tokenizer that drops white space and treats the words between alike wherever they stand.

    Words that come again are looked up in two generations of bounded size. Texts of Latin-1
    characters without special strings are lowered and cut as the tokenizer itself would, which
    leaves fewer different words and lets new ones skip its own normalising and cutting; others are
    only cut at white space.
    """

    def __init__(self, path: str, limit: int = 160_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.limit, self.young, self.old = limit, {}, {}
        self.words = re.compile("[^ \n\t\r]+").findall  # a subset of the white space it drops: parting here changes nothing
        letters, digits, spaces = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
        self.parts = re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^{spaces}{letters}{digits}]+").findall
        self.beyond = re.compile("[^\0-\xff]").search

    def cut(self, text: str) -> tuple[list[str], Tokenizer]:
        """Its words, and the tokenizer for those not met before."""
        if "<|" in text or not (text.isascii() or not self.beyond(text)):
            return self.words(text), self.tokenizer
        return self.parts(text.lower()), self.bare

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        words, tokenizer = self.cut(text or "")
        young = self.young
        missing = set(words).difference(young)
        if missing:
            if len(young) > self.limit:
                self.old, self.young = young, {}
                young, missing = self.young, set(words)
            unknown = []
            for w in missing:
                if (found := self.old.get(w)) is not None:
                    young[w] = found
                else:
                    unknown.append(w)
            for w, e in zip(unknown, tokenizer.encode_batch_fast(unknown, add_special_tokens=False), strict=True):
                young[w] = b"".join([i.to_bytes(4, "little") for i in e.ids])
        return b"".join(map(young.__getitem__, words))


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids, then the end id, in pieces of up to capacity. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(path)
        for batch in slices(batches):
            out = []
            for doc, x in zip(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist(), strict=True):
                whole = ids.packed(x) + end.to_bytes(4, "little")
                n = len(whole) // 4
                out += [(doc, k, a, min(n - a, capacity), zlib.crc32(whole[4 * a : 4 * (a + capacity)])) for k, a in enumerate(range(0, n, capacity))]
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, first rank, end rank, first sequence, pieces in each, offset).

    Sequences in the same state are one range of numbers. For a length, from the longest down, the
    fullest range with room takes as many pieces as fit, in all its sequences at once; what is left
    opens new ones. The work depends on the number of lengths, not of pieces.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out, opened = [], 0

    def fill(length: int, rank: int, left: int, first: int, n: int, room: int) -> tuple[int, int, int]:
        """Fills a range; gives the rank and number left, and how many of its sequences were used."""
        each = min(room // length, left)
        used = min(n, left // each)
        out.append((length, rank, rank + used * each, first, each, capacity - room))
        rooms[room - each * length].append((first, used))
        return rank + used * each, left - used * each, used

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for room in range(length, capacity):
            while left and rooms[room]:
                first, n = rooms[room].pop()
                while left and n:
                    rank, left, used = fill(length, rank, left, first, n, room)
                    first, n = first + used, n - used
                if n:
                    rooms[room].append((first, n))
            if not left:
                break
        while left:
            n = max(1, left // (capacity // length))
            rank, left, used = fill(length, rank, left, opened, n, capacity)
            opened += used
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset (long) to rows with a length of 1 to capacity.

    Only the histogram, of at most capacity rows, comes to the driver. A piece's rank within its
    length is its rank within a bucket of that length plus the sizes of the buckets before, so a
    length that a third of all pieces have is ranked in many tasks. The plan that is joined on the
    rank has a row for each length and range of sequences and is independent of the pieces' number.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "length long, low long, high long, first long, each long, base long")
    buckets = max(math.ceil(sum(counts.values()) / per_bucket), 2 * spark.sparkContext.defaultParallelism)
    order = [c for c in pieces.columns if c != "length"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_nth", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order)) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_nth") + F.col("_before")).drop("_bucket", "_nth", "_before").withColumnRenamed("length", "_length")
    placed = ranked.join(F.broadcast(slots), (F.col("_length") == F.col("length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    into = F.col("_rank") - F.col("low")
    return placed.select(*(F.col("length") if c == "length" else F.col(c) for c in pieces.columns), (F.col("first") + F.floor(into / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + into % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null or empty text is one piece of the end id alone. Rows of equal id, and a null id, are
    packed like any other. An empty table gives an empty table.
    """
    return pack(materialise(cut_pieces(df, path, capacity, end, text, doc_id), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))

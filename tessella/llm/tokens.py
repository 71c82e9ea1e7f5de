"""Operators 1 and 2: byte-level BPE encoding and decoding, and token counts."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bpe
from tessella.llm.common import slices, table


def _append(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != column), T.StructField(column, kind)])


def _with(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != column]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), values], names=[*keep, column])


def _many_objects() -> None:
    """Tables of many small objects that hold no cycles: the collector needn't go through them often."""
    gc.collect()
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)


@lru_cache(2)
def _encoder(ranks_path: str, pattern: str) -> bpe.Encoder:
    """One for each worker process: what it has learned serves the tasks after."""
    out = bpe.Encoder(bpe.Vocabulary.from_ranks(bpe.read_ranks(ranks_path)), pattern)
    _many_objects()
    return out


@lru_cache(2)
def _tokens(ranks_path: str) -> dict[int, bytes]:
    return {i: b for b, i in bpe.read_ranks(ranks_path).items()}


def _encoded(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(ranks_path, pattern)
    for batch in slices(batches):
        packed = [encoder.packed(x) for x in batch.column(text).to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64)
        if ends[-1] >= 2**31:
            raise ValueError("a batch has over 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
        yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values))


def _decoded(batches: Iterator[pa.RecordBatch], ranks_path: str, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(ranks_path)
    for batch in slices(batches):
        rows = (row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else None for row in batch.column(ids))
        yield _with(batch, text, pa.array([None if x is None else "".join(bpe.decode_stream(tokens, x)) for x in rows], pa.string()))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column, as array<int>; a column of that name is replaced.

    Each match of pattern is encoded by itself; special strings are ordinary text. A null or empty
    text has no ids. Rows are independent: one narrow stage, no shuffle, whole texts of any length.
    The path must be readable on every executor.
    """
    return df.mapInArrow(lambda batches: _encoded(batches, ranks_path, pattern, text, ids), _append(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of an id column. Null ids give null; bytes that aren't UTF-8 become U+FFFD; unknown ids raise."""
    return df.mapInArrow(lambda batches: _decoded(batches, ranks_path, ids, text), _append(df, text, T.StringType()))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode, then decode its ids, in one pass of one worker: adds both columns."""
    fields = [f for f in _append(df, ids, T.ArrayType(T.IntegerType())).fields if f.name != decoded]
    schema = T.StructType([*fields, T.StructField(decoded, T.StringType())])
    return df.mapInArrow(lambda batches: _decoded(_encoded(batches, ranks_path, pattern, text, ids), ranks_path, ids, decoded), schema)


class Counter:
    """Token counts of texts by state maps: what each chunk of a text does to the state of one counting transducer.

    All chunks of all texts move through the transducer at once. A chunk's map is known where it is
    asked for: at first from the state that the stretch before the chunk leads to, begun at the last
    place where a piece starts (there all states become one) or, in a longer piece, `look` bytes before.
    Where that isn't the state that the chunk before ends in, the map is extended by that state; equal
    chunks share their maps. Once each map's entry is its forerunner's exit, the maps compose by a prefix
    sum over chunks.
    """

    def __init__(self, vocabulary: bpe.Vocabulary, pattern: str, specials: list[str], chunk: int = 128, look: int = 64):
        self.pieces = bpe.splitter(pattern)
        self.split = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))).split if specials else lambda x: [x]
        self.table = bpe.CountTable(vocabulary)
        self.chunk, self.look = chunk, look

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """The count of each text, one for each special string in it. Null and empty texts have 0."""
        self.table.trim()
        out, bodies, sizes, lengths = np.zeros(len(texts), np.int64), [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            parts = self.split(text or "")
            out[k] = len(parts) - 1
            for part in parts:
                pieces = self.pieces(part)
                data = part.encode() if part.isascii() else None
                found = list(map(len, pieces)) if data is not None else [len(x.encode()) for x in pieces]
                if data is None or sum(found) != len(data):
                    data = "".join(pieces).encode()
                bodies.append(data)
                sizes.append(np.array(found, np.int64))
                lengths[k] += len(data)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        pieces = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))])[:-1]
        return out + self._counts(data, pieces, lengths)

    def total(self, text: str | None) -> int:
        return int(self.totals([text])[0])

    def _counts(self, data: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each text; they lie end to end in data, and a piece begins at each of pieces."""
        marks = np.zeros(len(data), bool)
        marks[pieces] = True
        chunks = -(-lengths // self.chunk)
        of = np.repeat(np.arange(len(lengths)), chunks)
        begin = np.cumsum(lengths) - lengths
        nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        starts = begin[of] + nth * self.chunk
        sizes = np.minimum(self.chunk, (begin + lengths)[of] - starts)
        entry, inner = np.zeros(len(of), np.int64), np.flatnonzero(nth)
        if len(inner):
            cut = starts[inner]
            back = np.minimum(cut - pieces[np.searchsorted(pieces, cut, "left") - 1], self.look)
            entry[inner] = self.table.run(data, marks, cut - back, back, np.zeros(len(inner), np.int64))[1]
        count, leave = self.table.run(data, marks, starts, sizes, entry)
        maps: dict[tuple[bytes, bytes, int], tuple[int, int]] = {}
        while True:
            wrong = inner[entry[inner] != leave[inner - 1]]
            if not len(wrong):
                break
            entry[wrong] = leave[wrong - 1]
            names = [(data[a : a + n].tobytes(), marks[a : a + n].tobytes(), e) for a, n, e in zip(starts[wrong].tolist(), sizes[wrong].tolist(), entry[wrong].tolist(), strict=True)]
            new = {name: k for name, k in zip(names, wrong.tolist(), strict=True) if name not in maps}
            some = np.fromiter(new.values(), np.int64, len(new))
            if len(some):
                maps.update(zip(new, zip(*(x.tolist() for x in self.table.run(data, marks, starts[some], sizes[some], entry[some])), strict=True), strict=True))
            count[wrong], leave[wrong] = np.array([maps[name] for name in names], np.int64).T
        scan = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(chunks)
        last = np.where(chunks > 0, self.table.rest(leave[np.maximum(ends - 1, 0)]) if len(leave) else 0, 0)
        return scan[ends] - scan[ends - chunks] + last


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_json(path: str) -> tuple[bpe.Vocabulary, list[str]]:
    """Vocabulary and added tokens of a byte-level BPE .json file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    special = [x["content"] for x in spec["added_tokens"]]
    tokens = {i: raw(t) for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
    return bpe.Vocabulary.from_merges(tokens, [(raw(a), raw(b)) for a, b in merges]), special


@lru_cache(2)
def _counter(json_path: str, pattern: str) -> Counter:
    vocabulary, special = read_json(json_path)
    out = Counter(vocabulary, pattern, special)
    _many_objects()
    return out


def token_counts(df: DataFrame, json_path: str, pattern: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of a text column (long); a column of that name is replaced.

    Added tokens of the vocabulary count one where their strings stand. Null and empty texts have 0.
    A narrow stage: no shuffle. Texts of any length are counted in chunks whose state maps compose.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(json_path, pattern)
        for batch in slices(batches, 1000):
            yield _with(batch, count, pa.array(counter.totals(batch.column(text).to_pylist()), pa.int64()))

    return df.mapInArrow(run, _append(df, count, T.LongType()))


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to ids and back: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs, path, P.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = token_counts(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), P.path("byte_bpe_50k.json"), P.PATTERN)
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))

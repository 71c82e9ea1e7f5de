"""Operator 10: SimHash fingerprints, all pairs within a radius by bit-sliced comparison, and their groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import materialise, slices, table
from tessella.llm.links import components, deal_tiles, joint_tiles, stars

BITS, RADIUS = 64, 3


def _shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six separators part words
    if not parts:
        return []
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(line, seed)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    return [digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=False)]


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """Adds the 64-bit fingerprint of each text (long; the bits count, not the sign). No shuffle.

    A bit is set if it is set in over half of the XXH64 hashes of the text's shingles, repeats
    included. A null text, or one without words, has fingerprint 0; fewer words than a shingle has
    make one shingle.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.zeros(batch.num_rows, np.uint64)
            for k, x in enumerate(batch.column(text).to_pylist()):
                h = np.array(_shingle_hashes(x, words, seed), np.uint64)
                if len(h):
                    ones = np.zeros(BITS, np.int64)
                    for i in range(0, len(h), 4096):
                        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
                    fps[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(fps.view(np.int64))], names=[*keep, out])

    return df.mapInArrow(run, schema)


def within(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All i < j whose fingerprints differ in at most radius (up to 3) bits.

    Bit planes lie vertically: a word holds one bit of 64 fingerprints, and a carry-save counter of
    two bits and an overflow counts the differences of 64 pairs at once. A word is abandoned as
    soon as all of its pairs are over the radius.
    """
    n = len(fps)
    width = -(-n // 64)
    bits = np.zeros((width * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)
    flip = np.where(bits[:n].T.astype(bool), ~np.uint64(0), np.uint64(0))
    row, col = np.divmod(np.arange(n * width), width)
    ahead = col * 64 + 63 > row  # else all of the word's fingerprints come before this one
    row, col = row[ahead], col[ahead]
    ones, twos, over = (np.zeros(len(row), np.uint64) for _ in range(3))
    for bit in range(BITS):
        d = planes[bit][col] ^ flip[bit][row]
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if bit % 8 == 7:
            live = over != ~np.uint64(0)
            if 2 * np.count_nonzero(live) < len(live):
                row, col, ones, twos, over = row[live], col[live], ones[live], twos[live], over[live]
    if radius < 3:
        over |= {2: ones & twos, 1: twos, 0: ones | twos}[radius]
    near = np.flatnonzero(over != ~np.uint64(0))
    hit, lane = np.nonzero(np.unpackbits((~over[near]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    i, j = row[near][hit], col[near][hit] * 64 + lane
    good = (i < j) & (j < n)
    return i[good], j[good]


def bands(n: int, radius: int = RADIUS) -> list[int]:
    """Masks such that any two fingerprints within the radius agree under one of them: all sets of blocks that radius blocks leave.

    More blocks make longer keys, for more fingerprints: 16, 25, 32, 36 or 40 bits.
    """
    blocks = radius + 1
    while blocks < 8 and n > 32 * 2 ** (BITS * (blocks - radius) // blocks):
        blocks += 1
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def groups(df: DataFrame, fp: str = "fp", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, component): for each fingerprint, the least id reachable over links of at most radius bits.

    Equal fingerprints are one item from the start, however many rows share them. Rows without an
    id or a fingerprint make no links.
    """
    items = materialise(df.where(F.col(fp).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).cast("long").alias("rep")), "fingerprints")
    masks = bands(items.count(), radius)
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)))
    rows = items.select("fp", F.inline(keys))
    dealt = deal_tiles(rows, ["t", "key"], F.xxhash64("fp")).select("tile", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joint_tiles(batches):
            fps = np.unique(t.column("fp").to_numpy())
            a, b = stars(len(fps), *within(fps.view(np.uint64), radius))
            yield pa.RecordBatch.from_pydict({"a": fps[a], "b": fps[b]})

    linked = components(dealt.mapInArrow(link, "a long, b long"))
    rooted = items.join(linked, items.fp == linked.id, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("fp", "component")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The ids with fingerprint (long) and component_id. A null id has a fingerprint but no component."""
    fps = materialise(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text").select("doc_id", "fp"), "simhash")
    found = fps.join(groups(fps), "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group: doc_id, fingerprint, component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, and their groups.

Candidates come from MinHash bands; every link is then decided on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, slices
from tessella.llm.links import BROADCAST_ROWS, components, deal_tiles
from tessella.llm.simhash import _shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with a probability of (1 - 0.8^5)^32 = 3e-6


def shingle_set(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """The sorted XXH64 hashes of a text's different shingles; none for a text without words."""
    return np.unique(np.array(_shingle_hashes(text, words, seed), np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: two sets agree on it with probability Jaccard^ROWS. An empty set has no keys."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    rng = np.random.default_rng(11)
    times, plus = (rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (times[:, None] * shingles[None, i : i + 1024] + plus[:, None]).min(axis=1))
    mixed = least * times[::-1]
    mixed ^= mixed >> np.uint64(29)
    return (mixed * plus).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def alike(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each of the sets the number of its group, of links with at least that Jaccard similarity.

    A set is compared with all others at once. Sets that are already in the largest group need no
    comparison with each other, so one large group takes few rounds.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    label, todo = np.arange(len(sets)), np.ones(len(sets), bool)
    mark = np.zeros(codes.max() + 1, bool)
    while True:
        rest = np.flatnonzero(todo & (label != np.bincount(label).argmax()))
        if not len(rest):
            return label
        k = rest[0]
        todo[k] = False
        mine = codes[starts[k] : ends[k]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[mine] = False
        near = both >= similarity * (sizes + sizes[k] - both) - 1e-9
        label[np.isin(label, label[near])] = label[k]


def first_of_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash) of the least row of each group of linked documents; text_hash is xxhash64(text).

    Equal sets are one item from the start, however many rows share them. Rows without an id are left out.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, words) for x in batch.column("text").to_pylist()]
            cols = {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "keys": pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), **cols})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "shingles": [shingle_set(x, words).tobytes() for x in batch.column("text").to_pylist()]})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            names = tile.column("digest").to_pylist()
            label = alike([np.frombuffer(s, np.uint64) for s in tile.column("shingles").to_pylist()], similarity)
            _, at, of = np.unique(label, return_index=True, return_inverse=True)
            pairs = [(names[at[g]], names[k]) for k, g in enumerate(of.tolist()) if at[g] != k]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = docs.mapInArrow(sign, "doc_id long, text_hash long, digest binary, keys array<long>")
    items = materialise(signed.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("keys").alias("keys")), "shingle-sets")
    rows = items.select("digest", F.explode("keys").alias("key"))
    # buckets of the same members are looked at once
    seen = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    once = seen.where("n > 1").groupBy("n", "lo", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = materialise(rows.join(once, "key"), "bands")
    wanted = materialise(members.select("digest").distinct().join(items.select("digest", "rep.*"), "digest"), "wanted")
    # texts are filtered where they are read, unless too many are wanted for that
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["doc_id", "text_hash"]).select("digest", "text").dropDuplicates(["digest"])
    sets = materialise(texts.mapInArrow(whole, "digest binary, shingles binary"), "shingles")
    dealt = deal_tiles(members, ["key"], F.xxhash64("digest"), then=lambda tiles: tiles.select("tile", "digest").join(sets, "digest"))
    linked = components(dealt.select("tile", "digest", "shingles").mapInArrow(link, "a binary, b binary"))
    rooted = items.join(linked, items.digest == linked.id, "left").select("rep", F.coalesce("component", "digest").alias("root"))
    return rooted.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.*")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by tile as one table a tile."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in slices(batches):
        tile = batch.column("tile").to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and tile[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tile[a]
    if held:
        yield pa.Table.from_batches(held)

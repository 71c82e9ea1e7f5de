"""Documents whose sets of word shingles have a Jaccard similarity of at least 0.8, found by SimHash, and their groups.

Fingerprints of 256 bits meet in tiles by keys of sampled bits, where a bit-sliced carry-save count
finds those within a radius; groups of these are candidates. Links are decided on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, slices
from tessella.llm.links import BROADCAST_ROWS, components, deal_tiles, stars, whole_tiles
from tessella.llm.minhash import SIMILARITY, WORDS, _tiles, alike, shingle_set

# At a Jaccard similarity of 0.8 bits differ with a probability of 0.152, at most 0.162 for small sets.
# Only of sets of 4 and 5 shingles 0.188 do: these also meet by their subsets of 4.
LANES, RADIUS, HALF_RADIUS = 4, 78, 46  # words of 64 bits; differing bits of all 256 and of the first 128
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Four words: the SimHash of a set of 64-bit hashes, and of three mixtures of them. Of a tie the bit is 0."""
    lanes = np.empty((len(shingles), LANES), np.uint64)
    lanes[:, 0] = shingles
    for k, odd in enumerate(ODD):
        mixed = (shingles ^ (shingles >> np.uint64(32))) * odd
        mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD[k - 1]
        lanes[:, k + 1] = mixed ^ (mixed >> np.uint64(32))
    ones = np.zeros(LANES * 64, np.int64)
    for i in range(0, len(lanes), 255):  # as many ones fit a byte
        ones += np.add.reduce(np.unpackbits(lanes[i : i + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def fours(shingles: np.ndarray) -> list[int]:
    """A key for each 4 shingles of a set of 4 or 5; none for other sizes."""
    subsets = [shingles] if len(shingles) == 4 else [np.delete(shingles, k) for k in range(5)] if len(shingles) == 5 else []
    return [xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in subsets]


def sampled(n: int) -> np.ndarray:
    """The bits of each key, a row a key, for n fingerprints: 2048 to 4096 share a key by chance.

    14 / 0.84^k keys of k bits. A pair at the threshold is missed with a probability of 2e-6 or less
    up to 500,000 fingerprints (k = 7) and of 8e-5 or less at 15 million, for small sets three times that. Up to 8192 all meet.
    """
    k = int(np.log2(n / 2048)) if n > 8192 else 0
    rng = np.random.default_rng(17)
    return np.stack([rng.permutation(LANES * 64)[:k] for _ in range(int(np.ceil(14 / 0.84**k)) if k else 1)])


def keys(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(fingerprint, key): the number of the key above the bits that it samples."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    out = np.tile(np.arange(len(places), dtype=np.int64), (len(fps), 1))
    for column in places.T:
        out = out << 1 | bits[:, column]
    return out


def _counter(planes: np.ndarray, flips: np.ndarray) -> list[np.ndarray]:
    """The differences of each row with 64 fingerprints a word, as a number whose bits lie in separate words, the lowest first."""
    waiting: list[list[np.ndarray]] = [[]]

    def put(level: int, d: np.ndarray) -> None:
        if level == len(waiting):
            waiting.append([])
        held = waiting[level]
        held.append(d)
        if len(held) == 3:  # a full adder
            a, b, c = held
            u = a ^ b
            held[:] = [u ^ c]
            put(level + 1, (a & b) | (u & c))

    for plane, flip in zip(planes, flips, strict=True):
        put(0, plane[None, :] ^ flip[:, None])
    level = 0
    while level < len(waiting):
        if len(waiting[level]) == 2:
            a, b = waiting[level]
            waiting[level] = [a ^ b]
            put(level + 1, a & b)
        level += 1
    return [held[0] for held in waiting]


def near(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints (rows of four words) within the radius, as (least item of the group, other item).

    The first 128 bits are counted bit-sliced, in strips of 256 fingerprints; the few pairs left, on all bits.
    """
    n = len(fps)
    width = -(-n // 64)
    bits = np.zeros((width * 64, 128), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fps[:, :2]).view(np.uint8), axis=1, bitorder="little")
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)
    flips = np.where(bits[:n].T.astype(bool), ~np.uint64(0), np.uint64(0))
    a, b, label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(n)
    for top in range(0, n, 256):
        left = top // 64
        counter = _counter(planes[:, left:], flips[:, top : top + 256])
        over, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
        for level in range(len(counter) - 1, -1, -1):
            if HALF_RADIUS >> level & 1:
                same &= counter[level]
            else:
                over |= same & counter[level]
                same &= ~counter[level]
        row, col = np.nonzero(~over)
        hit, lane = np.nonzero(np.unpackbits((~over[row, col]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = row[hit] + top, (col[hit] + left) * 64 + lane
        good = (i < j) & (j < n)
        i, j = i[good], j[good]
        good = label[i] != label[j]
        i, j = i[good], j[good]
        for part in range(0, len(i), 100_000):
            x, y = i[part : part + 100_000], j[part : part + 100_000]
            good = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1, dtype=np.int64) <= RADIUS
            if good.any():
                a, b = stars(n, np.concatenate([a, x[good]]), np.concatenate([b, y[good]]))
                label[b] = a
    return a, b


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equally many bytes as binary values."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.dtype.itemsize * (rows.shape[1] if len(rows) else 0))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LANES)


def first_of_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash) of the least row of each group of linked documents; text_hash is xxhash64(text).

    Equal sets are one item from the start, however many rows share them, and so are equal
    fingerprints while candidates are found. Rows without an id are left out; texts without words
    link with each other only.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, WORDS) for x in batch.column("text").to_pylist()]
            cols = {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "fp": pa.array([fingerprint(s).tobytes() if len(s) else None for s in sets], pa.binary()), "fours": pa.array([fours(s) for s in sets], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), **cols})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "shingles": [shingle_set(x, WORDS).tobytes() for x in batch.column("text").to_pylist()]})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                fps = _words(batch.column("fp"))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys(fps, places).ravel()), "fp": _binary(np.repeat(fps, len(places), axis=0))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_tiles(batches, ["tile"]):
            fps = _words(tile.column("fp"))
            a, b = near(fps)
            yield pa.RecordBatch.from_pydict({"a": _binary(fps[a]), "b": _binary(fps[b])})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            names = tile.column("digest").to_pylist()
            label = alike([np.frombuffer(s, np.uint64) for s in tile.column("shingles").to_pylist()], SIMILARITY)
            _, at, of = np.unique(label, return_index=True, return_inverse=True)
            pairs = [(names[at[g]], names[k]) for k, g in enumerate(of.tolist()) if at[g] != k]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = docs.mapInArrow(sign, "doc_id long, text_hash long, digest binary, fp binary, fours array<long>")
    items = materialise(signed.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("fp").alias("fp"), F.min("fours").alias("fours")), "shingle-sets")
    fps = materialise(items.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    places = sampled(max(1, fps.count()))
    met = deal_tiles(fps.select("fp").mapInArrow(spread, "key long, fp binary"), ["key"], F.xxhash64("fp"), limit=4096).select("tile", "fp")
    four = items.select(F.explode("fours").alias("four"), "fp")
    same = four.join(four.groupBy("four").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "four").select("a", F.col("fp").alias("b"))
    near_by = components(met.mapInArrow(meet, "a binary, b binary").unionByName(same))
    # sets of one fingerprint are candidates of each other, with or without near ones
    grouped = items.join(near_by, items.fp == near_by.id, "left").join(fps, "fp").where("component IS NOT NULL OR n > 1")
    members = materialise(grouped.select("digest", "rep.*", F.coalesce("component", "fp").alias("group")), "candidates")
    wanted = members.select("digest", "doc_id", "text_hash")
    # texts are filtered where they are read, unless too many are wanted for that
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["doc_id", "text_hash"]).select("digest", "text").dropDuplicates(["digest"])
    sets = materialise(texts.mapInArrow(whole, "digest binary, shingles binary"), "shingles")
    dealt = deal_tiles(members.select("group", "digest"), ["group"], F.xxhash64("digest"), then=lambda tiles: tiles.select("tile", "digest").join(sets, "digest"))
    linked = components(dealt.select("tile", "digest", "shingles").mapInArrow(link, "a binary, b binary"))
    rooted = items.join(linked, items.digest == linked.id, "left").select("rep", F.coalesce("component", "digest").alias("root"))
    return rooted.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.*")

"""Operators 4 and 5: exact top-k search by tiled products, and near-duplicate vectors by binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import materialise, slices, table
from tessella.llm.links import components, deal_parts, stars, whole_tiles


def _finite(vector: str) -> Column:
    """Whether a vector is there, isn't empty and has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


# --- exact top-k ---------------------------------------------------------------------------------


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_rows: int = 32_768, shard_rows: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of highest inner product, ties to smaller vec_id.

    Both inputs have vec_id (long, not null) and v (array<bigint>). Every row is a candidate, repeated
    ones as often as they occur, but those whose vec_id is the query's own; a query with fewer
    candidates gets all. A vec_id that occurs several times among the queries is one query, with the
    least of its vectors. Only vectors of one length are compared. Sums are exact; one that doesn't fit
    a long raises. Empty inputs give no rows.

    Queries and rows are cut into blocks and shards by a hash of the id. A tile is a block by a
    shard: one matrix product and a partial selection, in one task of bounded memory. n rows and m
    queries are shuffled as n * m * (1 / query_rows + 1 / shard_rows) copies. The tiles' lists are
    merged by a tree, 16 at a time.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries, n_rows = queries.count(), rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n_queries / query_rows))
    shards = max(1, math.ceil(n_rows / shard_rows), min(2 * cores, n_rows // 4096))
    deal = lambda *by, n: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("d")
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), size, deal("vec_id", n=blocks).alias("block"), every(shards).alias("shard"))
    r = rows.select("vec_id", "v", size, deal("vec_id", "v", n=shards).alias("shard"), every(blocks).alias("block"))

    def tile(qs: pa.Table, rs: pa.Table) -> pa.Table:
        if not qs.num_rows or not rs.num_rows:
            return found.empty_table()
        rs = rs.take(np.argsort(rs.column("vec_id").to_numpy(), kind="stable"))
        a, b = _matrix(qs.column("q"), np.int64), _matrix(rs.column("v"), np.int64)
        query, ids, shard = qs.column("query_id").to_numpy(), rs.column("vec_id").to_numpy(), rs.column("shard")[0].as_py()
        most = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object  # what holds each sum
        a, b = a.astype(kind), b.astype(kind)
        step = max(1, min(256, 4_000_000 // len(ids)))
        out = []
        for i in range(0, len(query), step):
            own = query[i : i + step, None] == ids[None, :]
            scores = np.where(own, kind(0) if kind is not object else 0, a[i : i + step] @ b.T)
            if kind is object and np.abs(scores).max() >= 2**63:
                raise OverflowError("an inner product doesn't fit a long")
            scores = scores.astype(np.int64)
            if k < len(ids):  # the k-th best score without the own rows; all that reach it come along
                masked = np.where(own, np.iinfo(np.int64).min, scores)
                least = np.partition(masked, len(ids) - k, axis=1)[:, len(ids) - k]
                keep = (masked >= least[:, None]) & ~own
            else:
                keep = ~own
            x, y = np.nonzero(keep)
            s = scores[x, y]
            order = np.lexsort((y, -s, x))
            x, y, s = x[order], y[order], s[order]
            nth = np.arange(len(x)) - np.searchsorted(x, x)
            best = nth < k
            out.append(pa.table({"query_id": query[i : i + step][x[best]], "vec_id": ids[y[best]], "score": s[best], "part": np.full(best.sum(), shard, np.int32)}, schema=found))
        return pa.concat_tables(out)

    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])
    lists = q.groupBy("d", "block", "shard").cogroup(r.groupBy("d", "block", "shard")).applyInArrow(tile, "query_id long, vec_id long, score long, part int")
    best = [F.desc("score"), F.asc("vec_id")]
    width = shards
    while width > 1:
        width = math.ceil(width / 16)
        lists = lists.withColumn("part", F.floor(F.col("part") / 16).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "part").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*best)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best rows for each row whose vec_id is divisible by 50.

    Vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows
    without a vec_id. A component whose 256-fold doesn't fit a long raises.
    """
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & _finite("embedding"))

    def whole(x: Column) -> Column:
        y = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long"))

    rows = rows.select("vec_id", F.transform("embedding", whole).alias("v"))
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score FROM q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

# --- near-duplicates -----------------------------------------------------------------------------


@lru_cache(16)
def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random rotation of d dimensions, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def rotated(unit: np.ndarray, turns: int) -> np.ndarray:
    """Unit vectors under several rotations, side by side, of length 1 again."""
    return np.concatenate([unit @ rotation(unit.shape[1], 11 + k).T for k in range(turns)], axis=1) / math.sqrt(turns)


PLANES = 4  # bits of a component on the query's side


class Codes:
    """Binary codes of unit vectors under random rotations, each with what corrects it, and the same vectors as queries.

    The code of o is x = sign(P o) / sqrt(D), kept as bits, with its factor <x, P o>. As a query, q is
    P q rounded at random, up or down so that the mean is right, to 4 bits a component, kept as bit
    planes with their offset and step. Then <x, P q> is a sum of popcounts of a code and the planes, and
    <x, P q> / <x, P o> is an unbiased estimate of <o, q>. What is left of x is at right angles to P o and
    looks anywhere, so that for a product of t the estimate has a standard deviation of at most
    sqrt((1 - t^2) (1 - factor^2) / (turns (d - 1)) + step^2 / 4) / factor.
    """

    def __init__(self, d: int, turns: int, code: np.ndarray, factor: np.ndarray, offset: np.ndarray, step: np.ndarray, planes: np.ndarray, total: np.ndarray):
        self.d, self.turns, self.code, self.factor, self.offset, self.step, self.planes, self.total = d, turns, code, factor, offset, step, planes, total

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        d = unit.shape[1]
        turns = math.ceil(64 / d)
        p = rotated(unit, turns)
        factor = np.maximum(np.abs(p).sum(axis=1) / math.sqrt(p.shape[1]), 1e-6).astype(np.float32)
        offset = p.min(axis=1).astype(np.float32)
        step = np.maximum((p.max(axis=1) - offset) / (2**PLANES - 1), 1e-9).astype(np.float32)
        at = (p - offset[:, None]) / step[:, None]
        level = np.clip(np.floor(at + np.random.default_rng(13).random(p.shape)), 0, 2**PLANES - 1).astype(np.uint8)
        planes = np.stack([_bits(level >> j & 1) for j in range(PLANES)], axis=1)
        return cls(d, turns, _bits(p >= 0), factor, offset, step, planes, level.sum(axis=1, dtype=np.float32))

    def stored(self) -> list[bytes]:
        """A row of bytes for each vector."""
        heads = np.stack([self.factor, self.offset, self.step, self.total], axis=1).astype("<f4")
        return [h.tobytes() + c.tobytes() + p.tobytes() for h, c, p in zip(heads, self.code, self.planes, strict=True)]

    @classmethod
    def read(cls, d: int, rows: list[bytes]) -> Codes:
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        factor, offset, step, total = raw[:, :16].copy().view("<f4").T
        words = raw[:, 16:].copy().view(np.uint64)
        wide = words.shape[1] // (PLANES + 1)
        return cls(d, math.ceil(64 / d), words[:, :wide], factor, offset, step, words[:, wide:].reshape(len(rows), PLANES, wide), total)

    def estimates(self, rows: slice) -> np.ndarray:
        """[r, c]: the estimated product of row r, by its code, and row c, as a query."""
        code, size = self.code[rows], self.d * self.turns
        hits = np.zeros((len(code), len(self.code)), np.float32)
        for j in range(PLANES):
            for w in range(code.shape[1]):
                hits += np.bitwise_count(code[:, None, w] & self.planes[None, :, j, w]) * np.float32(1 << j)
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.float32)
        return ((2 * ones - size)[:, None] * self.offset + (2 * hits - self.total) * self.step) / (math.sqrt(size) * self.factor[rows, None])

    def deviation(self, rows: slice, t: float) -> np.ndarray:
        """[r, c]: what an estimate of a product of t or more is off by, as a standard deviation."""
        f = np.minimum(self.factor[rows, None].astype(np.float64), 1)
        side = (1 - t * t) * (1 - f * f) / (self.turns * (self.d - 1)) if self.d > 1 else np.inf
        return np.sqrt(side + self.step[None, :].astype(np.float64) ** 2 / 4) / f

    def possible(self, t: float, rows: slice, eps: float = 4.0) -> np.ndarray:
        """[r, c]: whether the product of rows r and c may be t or more: the estimate is at most eps deviations below."""
        return self.estimates(rows) + eps * self.deviation(rows, t) >= t


def _bits(x: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words, filled up with 0."""
    packed = np.packbits(x.astype(bool), axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def table_plan(n: int, threshold: float, recall: float = 0.995, bucket: int = 512) -> tuple[int, int]:
    """Bits of a key, and how many keys, so that buckets hold about 512 of n and a pair at the threshold shares a key with probability recall."""
    bits = min(40, max(2, round(math.log2(max(n, 1) / bucket)) if n > bucket else 2))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(signs: np.ndarray, bits: int, tables: int, d: int) -> np.ndarray:
    """The first bits of the rotated vectors, so many a key; the vector's length stands above them."""
    return (signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))) + (np.int64(d) << 40)


def _digests(column: pa.Array) -> list[bytes | None]:
    """128 bits for each vector of doubles; equal for 0 and -0."""
    return [None if x is None else xxhash.xxh3_128_digest((np.array(x, np.float64) + 0.0).tobytes()) for x in column.to_pylist()]


def near_vectors(df: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", tile_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked at a cosine of at least threshold, and their groups.

    Equal vectors (by a 128-bit digest) are one item with a count. An item is stored once with the
    signs of its randomly rotated components, as bits, with correction factors, and as a query (see
    Codes). Slices of the bits are the keys of several tables, in whose buckets codes meet without
    their vectors; large buckets are cut into tiles. There popcounts give unbiased estimates, and only
    items of which a pair's confidence bound reaches the threshold ask for their vectors. Then each of
    those pairs is recomputed in double precision. A pair counts in the first table in which its keys
    agree, so once; tiles give counts and at most one edge an item, never their pairs. Keys are planned
    for a recall of 0.995 at the threshold itself and more above it; links reported are exact.

    Null or zero vectors, and ones with null or non-finite components, link with nothing, and only
    vectors of equal length link. A row without an id counts as no link and has no component. Rows
    of one id with different vectors are items of their own.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    good = F.col("vec_id").isNotNull() & _finite("v") & F.exists("v", lambda x: x != 0)
    kind = rows.schema["v"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_digests(b.column("v")), pa.binary())], names=[*b.schema.names, "digest"])

    usable = rows.select("vec_id", F.when(good, F.col("v")).alias("v")).mapInArrow(digested, f"vec_id long, v {kind}, digest binary")
    alone = usable.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    plain = materialise(alone.withColumn("item", F.monotonically_increasing_id()), "vectors")
    bits, tables = table_plan(plain.count(), threshold)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            vectors = b.column("v").to_pylist()
            length = np.array([len(v) for v in vectors])
            for d in np.unique(length).tolist():
                at = np.flatnonzero(length == d)
                unit = _unit(np.array([vectors[k] for k in at], np.float64))
                signs = rotated(unit, math.ceil(bits * tables / d)) >= 0
                columns = {"item": b.column("item").take(pa.array(at)), "code": Codes.of(unit).stored(), "keys": pa.array(list(_keys(signs, bits, tables, d)), pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(columns)

    codes = materialise(plain.select("item", "v").mapInArrow(coded, "item long, code binary, keys array<long>"), "codes")
    spread = codes.select("item", "code", F.posexplode("keys").alias("t", "key"))
    tile = ["key", "place", "high"]
    dealt = deal_parts(spread, ["t", "key"], F.xxhash64("item"), tile_rows)
    # the table and the lower part in one number; second: whether the row is of the higher part
    place = F.shiftleft(F.col("t").cast("long"), 32) + F.col("low")
    dealt = dealt.select("key", place.alias("place"), "high", ((F.col("low") < F.col("high")) & (F.col("part") == F.col("high"))).alias("second"), "item", "code")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tiles(batches, tile):
            some = np.unique(np.concatenate([np.append(i, j) for i, j in _undecided(t, threshold)]))
            if len(some):
                yield from t.select([*tile, "second", "item"]).take(pa.array(some)).to_batches()

    wanted = dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(near, "key long, place long, high int, second boolean, item long")
    whole = wanted.join(plain.select("item", "copies", "v").join(codes, "item"), "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tiles(batches, tile):
            yield pa.RecordBatch.from_pydict(_compare(t, threshold))

    found = materialise(whole.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(compare, "a long, b long, links long"), "vector-links")
    linked = components(found.where("links = 0").select("a", "b"))
    more = found.where("links > 0").groupBy(F.col("a").alias("item")).agg(F.sum("links").alias("more"))
    rooted = plain.select("item", "digest", "rep", "copies").join(more, "item", "left").join(linked.withColumnRenamed("id", "item"), "item", "left").withColumn("root", F.coalesce("component", "item"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(least, "root").select("digest", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = usable.select("vec_id", "digest").join(classes, "digest", "left")  # a hot vector is a skewed join of 24 bytes a row
    none = F.col("component_id").isNull() | F.col("vec_id").isNull()
    out = out.select("vec_id", F.when(none, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(none, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _undecided(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one tile, pairs of rows whose product may reach the threshold; of two parts, only pairs across."""
    d = t.column("key")[0].as_py() >> 40
    codes, second, inner = Codes.read(d, t.column("code").to_pylist()), t.column("second").to_numpy(), t.column("place")[0].as_py() & 0xFFFFFFFF == t.column("high")[0].as_py()
    yield np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(second), 256):
        i, j = np.nonzero(codes.possible(threshold, slice(start, start + 256)))
        i += start
        ok = i < j if inner else (i < j) & (second[i] != second[j])
        yield i[ok], j[ok]


def _compare(t: pa.Table, threshold: float) -> dict[str, np.ndarray]:
    """Of one tile: (a, b, 0) for edges of its groups, (a, a, links) for what a links with here."""
    unit, item, copies = _unit(_matrix(t.column("v"), np.float64)), t.column("item").to_numpy(), t.column("copies").to_numpy()
    keys, nth = _matrix(t.column("keys"), np.int64), t.column("place")[0].as_py() >> 32
    links, ends = np.zeros(len(item), np.int64), []
    for i, j in _undecided(t, threshold):
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            sure = np.einsum("nd,nd->n", unit[a], unit[b]) >= threshold
            a, b = a[sure], b[sure]
            ends.append((a, b))
            first = ~(keys[a, :nth] == keys[b, :nth]).any(axis=1)
            np.add.at(links, a[first], copies[b[first]])
            np.add.at(links, b[first], copies[a[first]])
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
    by = np.argsort(item)
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    root, other = stars(len(item), place[a], place[b])
    some = np.flatnonzero(links)
    return {"a": np.append(item[by[root]], item[some]), "b": np.append(item[by[other]], item[some]), "links": np.append(np.zeros(len(root), np.int64), links[some])}


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and group: vec_id, n_links, component_id, kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


NEAR_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
            vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
l AS (SELECT a.i, b.i AS j FROM e a JOIN e b ON a.i <> b.i AND a.good AND b.good AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(i, j) AS (SELECT i, i FROM e UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT r.i, min(e.vec_id) AS component_id FROM r JOIN e ON r.j = e.i GROUP BY r.i),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, coalesce(e.vec_id = component_id, false) AS kept
FROM e JOIN c ON e.i = c.i LEFT JOIN n ON e.i = n.i
"""

"""Groups of linked items: dealing buckets out in tiles of bounded size, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialise


BROADCAST_ROWS = 200_000  # of four longs and less: a few MB


def deal_parts(df: DataFrame, keys: list[str], part_of: Column, limit: int = 1024) -> DataFrame:
    """Deals the rows of each bucket (equal keys) out so that any two of them meet in one tile.

    A bucket of up to limit rows is one tile. A larger one is cut into parts by part_of, and each
    pair of parts is a tile of its own; a row then goes to as many tiles as its bucket has parts.
    Adds part (the row's own part), low and high (the tile's parts; equal if it holds one), all int.
    The table of large buckets is counted before it is broadcast.
    """
    large = materialise(df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("_parts")), "large-buckets")
    cut = df.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, keys, "left")
    cut = cut.withColumn("part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(part_of, F.col("_parts"))).cast("int"))
    other = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    dealt = cut.withColumn("_other", F.explode(other))
    return dealt.withColumn("low", F.least("part", "_other")).withColumn("high", F.greatest("part", "_other")).drop("_parts", "_other")


def deal_tiles(df: DataFrame, keys: list[str], part_of: Column, limit: int = 1024, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """deal_parts, and the rows sorted by tile (long): a hash, for users to whom two tiles in one only mean more to compare.

    What is heavy is better added by `then`, once rows are dealt: df is read once more for its counts.
    """
    out = deal_parts(df, keys, part_of, limit).withColumn("tile", F.xxhash64(*keys, "low", "high")).drop("low", "high")
    return (then(out) if then else out).repartition("tile").sortWithinPartitions("tile")


def whole_tiles(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by some columns, without nulls, as one table for each of their values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in by]
        if held and any(held[-1].column(n)[-1].as_py() != c[0] for n, c in zip(by, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        start = 0
        for end in (np.flatnonzero(new) + 1).tolist():
            held.append(batch.slice(start, end - start))
            yield pa.Table.from_batches(held)
            held, start = [], end
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def joint_tiles(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.Table]:
    """Batches of rows sorted by tile as tables that hold whole tiles, several small ones together."""
    held, n = [], 0
    for t in whole_tiles(batches, ["tile"]):
        held.append(t)
        n += t.num_rows
        if n >= rows:
            yield pa.concat_tables(held)
            held, n = [], 0
    if held:
        yield pa.concat_tables(held)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among n items as (least item of the group, other item): as many as items, whatever the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(n))
    return label[other], other


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that each id in an edge reaches. Ids without edges aren't returned.

    Each round hooks every node to its least neighbour, flattens the trees by pointer jumping and
    contracts the edges to the trees' roots, until no edge is left. All tables stay distributed and
    are written to the shared folder, so no round is computed twice.
    """

    def tidy(x: DataFrame, u: Column, v: Column) -> DataFrame:
        return materialise(x.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct(), "edges")

    left = tidy(edges, F.col(a), F.col(b))
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("u").alias("x"), F.col("v").alias("y")).union(left.select("v", "u"))
        p = materialise(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")), "hooks")
        moved = True
        while moved:
            to = p.select(F.col("x").alias("p"), F.col("p").alias("q"))
            before, p = p, materialise(p.join(to, "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jumps")
            discard(before)
            moved = not p.where("moved").isEmpty()
        if labels is None:
            labels = materialise(p.select(F.col("x").alias("id"), F.col("p").alias("component")), "labels")
        else:
            up = p.select(F.col("x").alias("component"), F.col("p").alias("_to"))
            before, labels = labels, materialise(labels.join(up, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "labels")
            discard(before)
        pu, pv = p.select(F.col("x").alias("u"), F.col("p").alias("pu")), p.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        before, left = left, tidy(left.join(pu, "u").join(pv, "v"), F.col("pu"), F.col("pv"))
        discard(before, p)
    if labels is None:
        labels = left.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels

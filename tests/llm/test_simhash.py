import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import links, simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    f = []
    for base in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        for _ in range(9):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << bit
            f.append(x)
    f = np.array(f, np.uint64)
    i, j = simhash.within(f, radius)
    want = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == list(map(tuple, want.tolist()))


def test_any_two_within_the_radius_agree_under_a_mask():
    rng = random.Random(3)
    for n in (100, 10**7, 10**10, 10**12):
        masks = simhash.bands(n)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), 3):
                y ^= 1 << bit
            assert any(x & m == y & m for m in masks)


def test_documents_as_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(60):
        base = [rng.choice(words) for _ in range(120)]
        for c in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows) * 2 + 1, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "One"), (1003, "oNE"), (1004, "two words"), (1005, "É é"), (1006, "É É"), (7, "again"), (7, "else"), (2000, "x y z " * 5000)]
    df = spark.createDataFrame([*rows, (None, "One")], "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    fps = [fingerprint(t) for _, t in rows]
    n = len(rows)
    edges = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = groups(n, edges)
    least = {}
    for k in range(n):
        least[root[k]] = min(least.get(root[k], rows[k][0]), rows[k][0])
    want = sorted((rows[k][0], fps[k], least[root[k]]) for k in range(n))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got if r.doc_id is not None) == want
    assert [(r.fp % 2**64, r.component_id) for r in got if r.doc_id is None] == [(fingerprint("One"), None)]


def test_a_large_bucket_is_cut_and_complete(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.col("id"))
    rows = links.deal_tiles(df, ["k"], F.xxhash64("id"), 50).collect()
    tiles = {}
    for r in rows:
        tiles.setdefault(r.tile, []).append(r.id)
    met = {(a, b) for t in tiles.values() for a in t for b in t}
    assert len(met) == 500 * 500 and max(map(len, tiles.values())) < 250


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    star = [(500, i) for i in range(100, 160)]
    other = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    edges = [*chain, *star, *other]
    rng.shuffle(edges)
    got = {r.id: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = groups(501, edges)
    assert got == {x: root[x] for e in edges for x in e if e[0] != e[1]} or all(got[x] == root[x] for x in got)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []

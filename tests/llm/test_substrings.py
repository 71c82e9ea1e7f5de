import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, length):
    """The contract, word for word: windows of the input, smaller ids first."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            f = first.get(tuple(w[i : i + length]))
            if f is not None and (d is None or f < d):
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows, length=4, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("group", F.lit(7))
    out = substrings.remove_repeats(df, length=length, **more)
    assert out.columns == ["doc_id", "text", "group", "n_words", "n_removed"]
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(5)]
    rows = []
    for d in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 9))) for _ in range(4)]
        rows.append((d * 3 + 1, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    return rows


def test_as_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows, 4) == plain(rows, 4)
    assert run(spark, rows, 4, block_chars=200, group_windows=20, subtree_leaves=3) == plain(rows, 4)


def test_edges(spark):
    long = " ".join(f"v{i % 50}" for i in range(4000))
    rows = [(5, None), (6, ""), (7, "a b c"), (8, "a b c d e"), (8, "a b c d e"), (9, "x a b c d y"), (None, "a b c d"), (None, "q r s t u"), (None, "q r s t u"), (2, long), (3, long), (10, "a b c　d e f g"), (11, "a b c　d e f h")]
    assert run(spark, rows, 4) == plain(rows, 4)


def test_windows_within_a_document_dont_count(spark):
    assert run(spark, [(1, "a b c d " * 5)], 4) == plain([(1, "a b c d " * 5)], 4)


def test_a_passage_that_many_share(spark):
    rows = [(i, f"u{i} " + "p q r s t u v w " + f"z{i}") for i in range(300)]
    assert run(spark, rows, 5, block_chars=300) == plain(rows, 5)


def test_empty_table(spark):
    assert run(spark, [], 4) == []


def test_codes_that_collide_change_nothing(spark):
    rows = corpus(2)
    for bits in (1, 3, 8):
        assert run(spark, rows, 4, bits=bits, subtree_leaves=5, block_chars=400) == plain(rows, 4)


def test_rows_without_an_id_are_spread_over_blocks(spark):
    rows = [(None, f"a{i} " + "p q r s t " * 3) for i in range(200)] + [(4, f"b{i} p q r s t") for i in range(50)]
    assert run(spark, rows, 4, block_chars=100) == plain(rows, 4)


def test_packing_is_exact():
    rng = np.random.default_rng(0)
    for codes in (np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64)), np.array([0, 2**63], np.uint64), np.array([5], np.uint64)):
        twice = rng.random(len(codes)) < 0.5
        a, b = substrings.unpack(substrings.pack(codes, twice))
        assert (a == codes).all() and (b == twice).all()


def test_prefixes_are_longer_where_many_suffixes_begin_alike():
    rng = np.random.default_rng(1)
    tokens = np.concatenate([np.tile([1, 2, 3, 4, 5, 6], 80), rng.integers(0, 40, 400)]).astype(np.int32)
    leaves = np.arange(len(tokens) - 6)
    parts = list(substrings.split_by_prefixes(tokens, leaves, 6, 30))
    assert sorted(np.concatenate([x for x, _ in parts]).tolist()) == leaves.tolist()
    assert {d for _, d in parts} >= {0, 6} and all(len(x) <= 30 or d == 6 for x, d in parts)
    assert all(len({tuple(tokens[i : i + d]) for i in x}) == 1 for x, d in parts)


def test_subtrees_hold_leaves_in_order_and_what_they_share():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 500).astype(np.int32)
    tree = substrings.Subtree(tokens, rng.permutation(490), 0, 8)
    rows = [tuple(tokens[i : i + 8]) for i in tree.leaves]
    assert rows == sorted(rows)
    lcp = [next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(rows, rows[1:], strict=False)]
    assert tree.shared[1:].tolist() == lcp
    ids = rng.integers(0, 100, 490)
    assert tree.least(ids).tolist() == [min(i for r, i in zip(rows, ids, strict=True) if r == row) for row in rows]


def test_anchors_are_equal_for_equal_windows():
    h = np.random.default_rng(3).integers(0, 2**63, 60, dtype=np.uint64)
    for length in (1, 3, 4, 5, 13):
        few = min(substrings.ANCHOR_WORDS, length)
        least = substrings._sum(h, few)
        assert substrings.anchors(h, length).tolist() == [int(least[i : i + length - few + 1].min()) for i in range(60 - length + 1)]

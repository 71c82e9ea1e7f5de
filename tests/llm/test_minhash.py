import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import minhash
from tests.llm.test_simhash import groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_near_copies_of_five_word_shingles_go(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(50):
        base = [rng.choice(vocabulary) for _ in range(150)]
        rows += [" ".join(edited(rng, base, k)) for k in (0, 1, 2, 3, 5, 9)]
    rows += ["", None, "One two", "one  TWO", "five words are one shingle", "five words are another shingle"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    texts = dict(zip(order, rows))
    sets = {d: plain(t) for d, t in texts.items()}
    edges = [(i, j) for i in texts for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    root = groups(len(rows), edges)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {d: texts[d] for d in texts if root[d] == d} and 100 < len(got) < 250


def test_a_large_group_in_many_tiles(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in minhash.first_of_groups(docs).collect()] == [0]


def test_groups_of_sets_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14)).astype(np.uint64)) for _ in range(25)]
        edges = [(i, j) for i in range(25) for j in range(i) if jaccard(set(sets[i]), set(sets[j])) >= 0.8]
        root, label = groups(25, edges), minhash.alike(sets)
        assert all((root[i] == root[j]) == (label[i] == label[j]) for i in range(25) for j in range(25))


def test_rows_of_one_id_with_different_texts_stay_if_their_groups_differ(spark):
    docs = spark.createDataFrame([(1, "a copy of text two", "en", "s", 1), (1, "another text of its own", "en", "s", 1), (2, "a copy of text two", "en", "s", 1)], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs.where(F.lit(True)), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "a copy of text two"), (1, "another text of its own")]

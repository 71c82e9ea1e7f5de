import random

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import minhash, nearcopies
from tests.llm.test_minhash import edited
from tests.llm.test_simhash import groups


def differ(a, b):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))


def test_the_pipeline_finds_candidates_by_fingerprints(spark, monkeypatch):
    def never(*_):
        raise AssertionError("MinHash bands in place of fingerprints")

    monkeypatch.setattr(minhash, "band_keys", never)
    monkeypatch.setattr(minhash, "first_of_groups", never)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base), " ".join(edited(random.Random(1), base, 2)), "another text"]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]


def test_a_fingerprint_has_the_bits_of_over_half_of_the_hashes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 254, 255, 256, 4080, 4081, 9000):
        h = rng.integers(0, 2**63, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)
        assert int(nearcopies.fingerprint(h)[0]) == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700])
def test_groups_within_the_radius_as_brute_force(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**63, (n, 4), dtype=np.uint64) * np.uint64(2)
    for k in range(1, n, 2):  # copies of others with up to 90 of 256 bits flipped
        bits = np.unpackbits(fps[rng.integers(k)].view(np.uint8))
        bits[rng.permutation(256)[: rng.integers(0, 91)]] ^= 1
        fps[k] = np.packbits(bits).view(np.uint64)
    near = [(i, j) for i in range(n) for j in range(i) if differ(fps[i], fps[j]) <= 78 and differ(fps[i, :2], fps[j, :2]) <= 46]
    a, b = nearcopies.near(fps)
    assert groups(n, near) == groups(n, list(zip(b.tolist(), a.tolist(), strict=True)))


def test_sets_of_four_and_five_shingles_meet_by_subsets():
    five = np.arange(5, dtype=np.uint64)
    for k in range(5):
        assert set(nearcopies.fours(np.delete(five, k))) <= set(nearcopies.fours(five))
    assert nearcopies.fours(five[:3]) == [] == nearcopies.fours(np.arange(6, dtype=np.uint64))


@pytest.mark.parametrize("size", [10, 15, 90, 450])
@pytest.mark.parametrize("n", [20_000, 15_000_000])
def test_sets_at_the_threshold_share_a_key_and_lie_within_the_radius(size, n):
    rng = np.random.default_rng(size)
    places, missed = nearcopies.sampled(n), 0
    for _ in range(150):
        union = rng.integers(0, 2**63, size, dtype=np.uint64)
        a, b = (nearcopies.fingerprint(x) for x in (union, union[: -(-4 * size // 5)]))  # Jaccard 0.8
        x, y = nearcopies.keys(np.stack([a, b]), places)
        missed += not (x == y).any() or differ(a, b) > 78 or differ(a[:2], b[:2]) > 46
    assert missed == 0


def test_many_keys_give_the_groups_that_bands_give(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = ["", None, "one two", "ONE  two"]
    for _ in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 8, 30, 200]))]
        texts += [" ".join(edited(rng, base, k)) for k in (0, 0, 1, 1, 4)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string").repartition(3)
    want = sorted(minhash.first_of_groups(docs).collect())
    assert sorted(nearcopies.first_of_groups(docs).collect()) == want
    real = nearcopies.sampled
    monkeypatch.setattr(nearcopies, "sampled", lambda n: real(100_000))
    assert sorted(nearcopies.first_of_groups(docs).collect()) == want

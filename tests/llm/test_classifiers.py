import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import learning, quality, toxicity

SYLLABLES = "th er on an re in at ou ed st en or".split()
BAD = ["vileness", "grubbish", "vilehood", "grubber"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def junk(rng, n):
    w = word(rng)
    return rng.choice([lambda: " ".join([w] * n), lambda: " | ".join(word(rng) for _ in range(n)), lambda: " ".join(word(rng).upper() + "!!" for _ in range(n)), lambda: " ".join(word(rng) + rng.choice(["***", "%%%"]) for _ in range(n))])()


def toxic(rng, n):
    words = prose(rng, n).split(" ")
    for _ in range(3):
        words.insert(rng.randrange(len(words) + 1), rng.choice(BAD[:3]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for d in range(700):
        bad, vile = rng.random() < 0.3, rng.random() < 0.3
        text = junk(rng, rng.randint(20, 120)) if bad else toxic(rng, rng.randint(30, 300)) if vile else prose(rng, rng.randint(10, 300))
        docs.append((d, text))
        labels.append((d, int(not bad), int(vile and not bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("_id", F.lit(0))
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    rows = learning.judged(quality.quality_scores(docs, labels), 3, 1, 0.5).join(labels, "doc_id").collect()
    assert len(rows) == 700 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97


def test_toxicity_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    rows = learning.judged(toxicity.toxicity_scores(docs, labels), 4, 2, 0.3).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_long_and_odd_texts_and_no_labels(spark, corpus):
    _, labels = corpus
    rng = random.Random(2)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, prose(rng, 20_000)), (None, "no id"), (4, "\x00 漢字 " * 50), (4, "twice")], "doc_id long, text string")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        for known in (labels, labels.where("doc_id < 0"), labels.where("quality = 1 and toxic = 0")):
            rows = scores(odd, known).collect()
            assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert scores(odd.limit(0), labels).collect() == []


def test_the_worst_window_counts_wherever_it_is(spark, corpus):
    docs, labels = corpus
    net = toxicity.train(docs, labels)
    rng = random.Random(3)
    words = prose(rng, 3000).split(" ")
    for at in (0, 1500, 2999):
        assert net.scores([" ".join([*words[:at], *rng.sample(BAD[:3], 3), *words[at:]])])[0] > 0.3
    assert net.scores([" ".join(words)])[0] < 0.3


def test_every_word_lies_in_a_window_and_windows_overlap():
    for n in (1, 23, 24, 25, 40, 41, 1000):
        starts = toxicity.Batch._starts(n)
        covered = np.zeros(max(n, 24), int)
        for s in starts:
            covered[s : s + 24] += 1
        assert covered[:n].all() and (np.diff(starts) <= toxicity.STRIDE).all()


def test_gradients():
    """Backpropagation against differences, in the parameters' own precision."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    b = toxicity.Batch(["some words here", "and other words stand " * 8, "x"])
    part, windows = toxicity._part(b, b.windows)
    target = rng.integers(0, 2, len(windows)).astype(np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss():
        z = net.forward(net.embed(part).astype(np.float64), windows)
        return float(np.mean(np.logaddexp(0, z) - target * z))

    before = {k: v.copy() for k, v in net.p.items()}
    net.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    grads = {}
    original = net.p
    net.backward(part, net.embed(part), windows, target, 0.0)
    for k in original:
        grads[k] = net.m[k][0] / 0.1
        net.p[k] = before[k].copy()
    for k in ("wf", "ub", "cb", "uf", "att", "att0", "pick", "out", "out0", "word", "gram"):
        flat, g = net.p[k].reshape(-1), grads[k].reshape(-1)
        for i in [int(np.abs(g).argmax()), *rng.integers(0, len(flat), 3).tolist()]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 2e-3 + 0.05 * abs(g[i]), k


def test_ranking_puts_the_cut_at_the_share_of_label_0():
    rng = np.random.default_rng(1)
    x = np.zeros((200, 256 + quality.OTHER), np.float32)
    label = (np.arange(200) >= 60).astype(int)
    x[:, 0] = label + rng.normal(0, 0.1, 200)
    r = quality.Ranking(x, label)
    z = ((x - r.mean) / r.scale) @ r.weights
    assert ((z >= r.cut) == (label == 1)).all()

import random
import zlib

import numpy as np

from tessella.llm import learning, quality
from tests.llm.test_classifiers import junk, prose


def test_the_nth_least_is_exact(spark):
    rng = np.random.default_rng(2)
    x = [*rng.normal(0, 5, 500).tolist(), *[0.25] * 20, -0.0, 0.0, 1e-300, -1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for n in (0, 1, 200, 262, 270, 300, len(x) - 1):
        assert learning.nth_least(df, "x", n) == sorted(x)[n]


def test_the_cut_comes_from_all_labelled_documents_whatever_the_sample(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for d in range(600):
        bad = rng.random() < 0.15
        docs.append((d, junk(rng, 40) if bad != (rng.random() < 0.1) else prose(rng, 60)))  # some labels mislead
        labels.append((d, int(not bad)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    mine = [d for d in range(600) if zlib.crc32(str(d).encode()) % 3 != 1]
    n_bad = sum(1 - labels[d][1] for d in mine)
    for per_label in (30, 60, 5000):
        model = quality.train(df, known, per_label)
        s = model.strengths([docs[d][1] for d in mine])
        ordered = np.sort(s)
        assert np.isclose(model.cut, (ordered[n_bad - 1] + ordered[n_bad]) / 2)
        assert (s < model.cut).sum() == n_bad

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import packing, quality, simhash, substrings, toxicity
from tests.llm.test_classifiers import junk, prose, toxic
from tests.llm.test_simhash import fingerprint, groups
from tests.llm.test_substrings import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    passage = prose(rng, 80)
    texts, labels = [], []
    for d in range(400):
        kind = rng.random()
        text = junk(rng, 60) if kind < 0.2 else toxic(rng, 80) if kind < 0.4 else texts[rng.randrange(len(texts))] if kind < 0.5 and texts else prose(rng, 90)
        if kind > 0.9:
            text += " " + passage
        texts.append(text)
        labels.append((d, int(kind >= 0.2), int(0.2 <= kind < 0.4)))
    for d in range(400):  # copies carry the labels of what they copy
        labels[d] = (d, *labels[texts.index(texts[d])][1:])
    texts += [None, "", prose(rng, 9000)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in enumerate(texts)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_do_what_their_names_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, folder)
        if name != "packing":
            assert dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        kept[name] = {r.doc_id for r in rows}
        if name == "toxicity":
            wrong = [d for d in before if d in labels and (d in kept[name]) == bool(labels[d].toxic)]
            assert len(wrong) <= 0.03 * len(before)
        if name == "quality":
            wrong = [d for d in before if d in labels and (d in kept[name]) != bool(labels[d].quality)]
            assert len(wrong) <= 0.03 * len(before)
        if name == "near_copies":
            ids = sorted(before)
            fps = [fingerprint(before[d]) for d in ids]
            root = groups(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
            assert kept[name] == {d for k, d in enumerate(ids) if root[k] == k}
        if name == "repeats":
            want = {d: t for d, _, _, t in plain(sorted(before.items()), 13)}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
            assert any(want[d] != " ".join((before[d] or "").split()) for d in want)
        if name == "packing":
            assert kept[name] == set(before)
        docs = spark.createDataFrame(rows, out.schema)
    assert sorted(corpus_pipeline.run(spark, folder).select("doc_id", "piece", "ids_crc32").collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).collect() == []
    assert corpus_pipeline.pack(spark, docs, folder).collect() == []


def test_rows_without_ids_and_repeated_ids(spark, folder):
    docs = spark.createDataFrame([(None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3)], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert sorted((r.doc_id is None for r in out.collect())) == [False, True, True]
    assert corpus_pipeline.cut_repeats(spark, docs, folder).count() == 4


def test_operators_are_those_of_the_list():
    used = {f.__module__ for f in (toxicity.train, quality.train, simhash.groups, substrings.remove_repeats, packing.pack)}
    assert len(used) == len(corpus_pipeline.STAGES) == 5 and F is not None

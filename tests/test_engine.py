import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.operators import model
from tessella.plans import catalogue
from tessella.plans.pipeline import NO_EVIDENCE, Corpus
from tessella.sources.folder import read_folder
from tessella.streaming.incremental import progress_counts, watch_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in re.findall(r"\w+", "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_as_their_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(want)


def test_the_entry_has_all_parts():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "hybrid_search" in entry.queries()


def write(folder, **files):
    for name, data in files.items():
        path = os.path.join(folder, name.replace("__", "/").replace("_DOT_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_folders(spark, tmp_path):
    write(tmp_path, a_DOT_TXT=b"x", sub__b_DOT_md=b"\xff\xfe ok", sub___c_DOT_log=b"", skip_DOT_png=b"x", noext=b"x")
    write(tmp_path, sub__a_DOT_TXT="é".encode())
    rows = {os.path.relpath(r.path, tmp_path): r for r in read_folder(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.TXT", "sub/_c.log", "sub/a.TXT", "sub/b.md"]
    assert rows["sub/b.md"].text == "�� ok" and rows["sub/a.TXT"].char_count == 1 and rows["sub/_c.log"].size == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    write(root, src__a_DOT_txt="第1章 総則\n（目的）\nこの規程は扶養手当について定める。\n第2条 住居手当は別に定める。\n".encode(), src__b_DOT_md=b"# Guide\n## Use\nCall the API with care.\n")
    c = Corpus(spark, f"file://{root}/store")
    first = c.index_folder(f"{root}/src")
    return c, root, first


def test_indexing_is_incremental(spark, corpus):
    c, root, first = corpus
    assert (first["scanned"], first["indexed"], first["failed"]) == (2, 2, 0)
    assert c.index_folder(f"{root}/src")["skipped"] == 2
    before = c.store.read("chunks").count()
    write(root, src__b_DOT_md=b"# Guide\n## Use\nCall the API with care.\n## More\nAnd test it.\n")
    again = c.index_folder(f"{root}/src")
    assert (again["indexed"], again["skipped"]) == (1, 1) and again["chunk_count"] == before + 1
    for name in ("postings", "lengths", "terms", "vectors", "sections"):
        assert c.store.read(name).select("document_id").distinct().count() == 2
    hits = c.search({"q": "API"}).orderBy("rank").collect()
    assert hits[0].heading_path == "Guide > Use" and "API" in hits[0].snippet


def test_answers(corpus):
    c, _, _ = corpus
    got = c.answer("扶養手当はどうなっていますか")
    assert got.facts and got.metrics["verdict"] == "pass" and got.stages[-1]["stage"] == "complete"
    assert all(f["chunk_id"] // 1_000_000 in (1, 2) for f in got.facts)

    class Silent(model.OfflineClient):
        def complete(self, kind, prompt, max_tokens):
            return "no json" if kind == "extract" else super().complete(kind, prompt, max_tokens)

    assert c.answer("API", client=Silent()).answer == NO_EVIDENCE


class Flaky:
    def __init__(self, after):
        self.left = after

    def complete(self, kind, prompt, max_tokens):
        if self.left:
            self.left -= 1
            raise model.RateLimited(2)
        return "done"


def test_waits_are_few_and_short():
    waited = []
    assert model.patiently(Flaky(2), "answer", "", waited.append) == "done" and waited == [2, 2]
    with pytest.raises(model.RateLimited):
        model.patiently(Flaky(3), "answer", "", waited.append)


def test_waves_leave_what_stays_limited(spark):
    class Limited:
        def complete(self, kind, prompt, max_tokens):
            if prompt == "2":
                raise model.RateLimited(None)
            if prompt == "3":
                raise ValueError("broken")
            return prompt

    prompts = spark.createDataFrame([(k, str(k)) for k in range(4)], "batch_id long, prompt string")
    got = {r.batch_id: (r.raw, r.error) for r in model.ask_in_waves(prompts, "extract", Limited(), lambda df: spark.createDataFrame(df.collect(), df.schema)).collect()}
    assert got == {0: ("0", None), 1: ("1", None), 2: (None, "rate_limit"), 3: (None, "broken")}


def test_streams(spark, tmp_path):
    write(tmp_path, src__a_DOT_txt=b"needle in a haystack")
    c = Corpus(spark, f"file://{tmp_path}/store")
    q = watch_folder(spark, f"{tmp_path}/src", c, f"{tmp_path}/check")
    q.awaitTermination(120)
    assert c.store.read("chunks").count() == 1
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert progress_counts(events.withColumn("ts", events.ts.cast("timestamp"))).groupBy().sum("n").first()[0] == events.count()

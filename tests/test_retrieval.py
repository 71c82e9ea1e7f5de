import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import catalog, context, expand, index, search
from tessella.operators.chunking import linked


def corpus(spark, rows):
    """(document_id, [contents]) -> chunks."""
    flat = [(d * 1_000_000 + k, d, f"{d}.txt", f"/{d}.txt", k, "", k * 10, k * 10 + 9, c) for d, cs in rows for k, c in enumerate(cs)]
    return linked(spark.createDataFrame(flat, "chunk_id long, document_id long, file_name string, path string, ordinal long, heading_path string, char_start long, char_end long, content string"))


def ids(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "document_id long")


def test_documents_are_filtered_before_the_cap(spark):
    chunks = corpus(spark, [(1, ["needle in hay"] * 181), (2, ["needle in hay"])])
    ix, reqs = search.Index.over(chunks), search.requests(spark, {"q": "needle"})
    for ranker in (search.fts, search.ngram, search.vector):
        assert [r.chunk_id for r in ranker(reqs, ix, ids(spark, 2)).collect()] == [2_000_000]
    hits = search.hybrid_search(reqs, ix, ids(spark, 2)).collect()
    assert [h.chunk_id for h in hits] == [2_000_000]
    assert search.fts(reqs, ix, ids(spark, 1, 2)).count() == 180


def test_no_documents_no_hits(spark):
    chunks = corpus(spark, [(1, ["needle"])])
    assert search.hybrid_search(search.requests(spark, {"q": "needle"}), search.Index.over(chunks), ids(spark)).collect() == []


def test_phrases_need_their_tokens_in_sequence(spark):
    chunks = corpus(spark, [(1, ["red green blue"]), (2, ["green red blue"]), (3, ["red-green and red_green"])])
    reqs = spark.createDataFrame([("q", "red green", [])], "query_id string, query string, terms array<string>")
    rows = search.fts(reqs, search.Index.over(chunks), ids(spark, 1, 2, 3)).collect()
    assert {r.chunk_id for r in rows} == {1_000_000, 3_000_000}


def test_neighbours_come_along_and_ties_go_to_the_smaller_id(spark):
    chunks = corpus(spark, [(1, ["a0 a0", "needle", "b0 b0"]), (2, ["needle"])])
    hits = search.hybrid_search(search.requests(spark, {"q": "needle"}), search.Index.over(chunks), ids(spark, 1, 2), 4).orderBy("rank").collect()
    assert [h.chunk_id for h in hits[:2]] == [1_000_001, 2_000_000] and {h.chunk_id for h in hits[2:]} == {1_000_000, 1_000_002}
    assert "ngram=Some(1)" in hits[0].debug


def test_results_dont_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(d, [" ".join(rng.choice("red green blue needle hay stack".split()) for _ in range(30)) for _ in range(3)]) for d in range(20)]
    chunks, reqs = corpus(spark, rows), search.requests(spark, {"a": "needle hay", "b": "blue"})
    outs = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        outs.append(sorted(map(tuple, search.hybrid_search(reqs, search.Index.over(chunks.repartition(n)), ids(spark, *range(20))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert outs[0] == outs[1]


def test_dense_vectors_are_unit_length(spark):
    v = index.hash_vectors(corpus(spark, [(1, ["some words to hash"])]), "chunk_id", F.col("content"))
    (row,) = index.dense(v, "chunk_id").collect()
    assert len(row.vector) == 384 and sum(x * x for x in row.vector) == pytest.approx(1, abs=1e-6)


def test_the_fourth_hit_of_a_document_is_lowered(spark):
    hits = spark.createDataFrame([("q", k, 1, 1.0 - k / 100) for k in range(5)] + [("q", 9, 2, 0.9)], "query_id string, chunk_id long, document_id long, score double")
    got = search.diversify(hits, 6).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 9, 3, 4] and got[4].score == pytest.approx(0.97 * 0.86)


def model_guided(rows, limit, step):
    merged = {}
    for seq in sorted({r[1] for r in rows}):
        for _, s, c, d, score in sorted(r for r in rows if r[1] == seq):
            if c in merged:
                merged[c][2] = round(max(merged[c][2], score) + step, 9)
            else:
                merged[c] = [c, d, score]
        order, seen = sorted(merged.values(), key=lambda h: (-h[2], h[0])), {}
        for h in order:
            n = seen.get(h[1], 0)
            if n >= 3:
                h[2] = round(h[2] * 0.86, 9)
            seen[h[1]] = n + 1
        merged = {h[0]: h for h in sorted(order, key=lambda h: (-h[2], h[0]))[:limit]}
    return [tuple(h) for h in merged.values()]


def test_guided_merges_compound(spark):
    rng = random.Random(2)
    rows = list({("r", s, c): ("r", s, c, c % 3, rng.randint(1, 99) / 100) for s in range(12) for c in rng.sample(range(20), 6)}.values())
    got = expand.guided_merge(spark.createDataFrame(rows, "run_id string, seq long, chunk_id long, document_id long, score double"), limit=10).orderBy("rank").collect()
    assert [(r.chunk_id, r.document_id, r.score) for r in got] == model_guided(rows, 10, 0.01)


def test_guided_merges_of_many_queries_take_one_pass(spark):
    rng = random.Random(5)
    rows = [(run, s, c, c % 7, rng.randint(1, 99) / 100) for run in ("a", "b") for s in range(30_000) for c in rng.sample(range(90), 3)]
    rows += [(None, 3, 1, 1, 0.5), (None, 1, 1, 1, 0.25)]
    rng.shuffle(rows)
    hits = spark.createDataFrame(rows, "run_id string, seq long, chunk_id long, document_id long, score double")
    start = time.monotonic()
    got = expand.guided_merge(hits).collect()
    assert time.monotonic() - start < 25  # a pass over a run's rows for each of its queries takes minutes
    few = [r for r in rows if r[1] < 300]
    got_few = expand.guided_merge(hits.where("seq < 300")).orderBy("rank").collect()
    for run in ("a", "b", None):
        assert [(r.chunk_id, r.document_id, r.score) for r in got_few if r.run_id == run] == model_guided([r for r in few if r[0] == run], 64, 0.01)
        assert sorted(r.rank for r in got if r.run_id == run) == list(range(1, 2 if run is None else 65))


def test_corrective_merges_in_order(spark):
    rows = [("r", 1, 1, -1, 0.5), ("r", 1, 1, 3, 0.2), ("r", 1, 1, 5, 0.9), ("r", 2, 2, 4, 0.3)]
    got = {r.chunk_id: r.score for r in expand.corrective_merge(spark.createDataFrame(rows, "run_id string, chunk_id long, document_id long, seq long, score double")).collect()}
    assert got == {1: pytest.approx(0.915), 2: pytest.approx(0.3)}


def test_concepts_of_a_broad_question(spark):
    chunks = corpus(spark, [(1, ["扶養手当の額を定める。"]), (2, ["住居手当を支給する。住居手当は月額とする。"])]).withColumn("heading_path", F.when(F.col("document_id") == 1, "第1章 総則 > （扶養手当）").otherwise(""))
    got = expand.source_concepts(chunks, search.requests(spark, {"q": "手当はどうなっていますか"})).first().concepts
    assert {"扶養手当", "住居手当"} <= set(got) and "総則" not in got and got == sorted(got, key=lambda x: x.encode())


def test_rollups(spark):
    chunks = corpus(spark, [(1, ["扶養手当", "b " * 200]), (2, ["x"])]).withColumn("heading_path", F.when(F.col("ordinal") == 0, "（扶養手当）").otherwise(""))
    s = {(r.document_id, r.heading_path): r for r in index.section_rollup(chunks).collect()}
    assert s[1, "（扶養手当）"].concepts == ["扶養", "扶養手当"] and s[1, "(見出しなし)"].chunk_ids == [1_000_001]
    assert s[1, "(見出しなし)"].summary_text.endswith("...")
    docs = spark.createDataFrame([(1, "1.txt", 9), (2, "2.txt", 1)], "id long, file_name string, char_count long")
    d = {r.document_id: r for r in index.document_rollup(docs, chunks).collect()}
    assert d[1].chunk_count == 2 and d[1].heading_index == ["（扶養手当）"] and d[1].summary_text.startswith("document=1.txt chars=9 chunks=2")


def test_contexts(spark):
    chunks = corpus(spark, [(1, ["扶養手当 a", "b"]), (2, ["x"])]).withColumn("heading_path", F.lit("（扶養手当）"))
    docs = spark.createDataFrame([(1, "1.txt", "/1", 9), (2, "2.txt", "/2", 1)], "id long, file_name string, path string, char_count long")
    names = docs.select(F.col("id").alias("document_id"), "file_name", "path")
    documents = index.document_rollup(docs, chunks).join(names, "document_id")
    sections = context.relevant_sections(index.section_rollup(chunks).join(names, "document_id"), F.array(F.lit("扶養")), F.array(F.lit(2_000_000).cast("long")), True)
    assert [(r.document_id, r.score) for r in sections.orderBy("rank").collect()] == [(2, 17.0), (1, 9.0)]
    assert context.corpus_concepts(F.array(F.lit("zz")), documents, sections).first().concepts == ["zz", "扶養", "扶養手当"]
    batches = {r.batch_id: r.context for r in context.batch_contexts(chunks.withColumn("batch_id", F.col("document_id")), documents, sections, ["c1"]).collect()}
    batch = batches[1]
    assert len(batches) == 2 and batches[2].count("file=2.txt") == 2
    assert batch.count("file=1.txt") == 2 and "file=2.txt" not in batch and batch.startswith("CORPUS concepts: c1\n")
    assert "RELEVANT" in context.answer_context(documents, sections, ["c"], True) and "RELEVANT" not in context.answer_context(documents, sections, ["c"], False)


def test_greedy_bins(spark):
    rng = random.Random(3)
    sizes = [rng.choice([10, 500, 2000, 7000]) for _ in range(60)]
    chunks = corpus(spark, [(1, ["x" * n for n in sizes])])
    got = {r.chunk_id % 1_000_000: r.bin for r in context.bins(chunks, ["document_id"], ["ordinal"]).collect()}
    used, bin_ = 0, -1
    for k, n in enumerate(sizes):
        if bin_ < 0 or used + n + 80 > 6000:
            bin_, used = bin_ + 1, 0
        used += n + 80
        assert got[k] == bin_


def test_context_stops_at_the_first_block_that_is_too_much(spark):
    hits = spark.createDataFrame([("q", k, "f", k, 0, 1, "h", "x" * n) for k, n in enumerate([100, 100, 900, 10], 1)], "query_id string, rank int, file_name string, chunk_id long, char_start long, char_end long, heading_path string, snippet string")
    text = context.context_text(hits, 400).first().context
    assert text.startswith("[S1] file=f chunk=1 chars=0-1 heading=h\n") and "[S2]" in text and "[S4]" not in text


def test_focused_chunks(spark):
    chunks = corpus(spark, [(1, list("abcdefgh"))]).withColumn("heading_path", F.when(F.col("ordinal") < 6, "H").otherwise(""))
    got = [r.chunk_id % 100 for r in expand.focused_chunks(chunks, ids(spark, 0).select(F.lit(1_000_005).cast("long").alias("chunk_id"))).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6]


def test_catalogue(spark):
    schema = "id long, path string, file_name string, size long, mtime_ms long, sha256 string, char_count long, selected boolean, status string, error string"
    known = spark.createDataFrame([(1, "/a", "a", 1, 1, "A", 1, False, "indexed", None), (2, "/b", "b", 1, 1, "B", 1, True, "missing", "gone"), (3, "/c", "c", 1, 1, "C", 1, True, "indexed", None), (4, "/e", "e", 0, 1, "E", 0, True, "indexed", None)], schema)
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    scan = known.where("path <> '/c'").withColumn("mtime_ms", F.when(F.col("path") == "/a", 2).otherwise(F.col("mtime_ms")))
    assert {r.path for r in catalog.changed(scan, known, chunks).collect()} == {"/a", "/e"}  # an empty file never has chunks
    marked = {r.path: r.status for r in catalog.mark_missing(known, scan).collect()}
    assert marked == {"/a": "indexed", "/b": "missing", "/c": "missing", "/e": "indexed"}
    assert {r.path: r.status for r in catalog.mark_missing(known, scan, heal=True).collect()}["/b"] == "indexed"
    new = spark.createDataFrame([(None, "/a", "a", 5, 9, "A2", 5, True, "indexed", None), (None, "/z", "z", 5, 9, "Z", 5, None, "indexed", None), (None, "/d", "d", 5, 9, "D", 5, None, "indexed", None)], schema)
    up = {r.path: (r.id, r.selected, r.size) for r in catalog.upsert(known, new).collect()}
    assert up["/a"] == (1, False, 5) and up["/d"] == (5, True, 5) and up["/z"] == (6, True, 5) and len(up) == 6
    assert {r.document_id for r in catalog.resolve_selection(known).collect()} == {3, 4}
    assert {r.document_id for r in catalog.resolve_selection(known, [2, 99]).collect()} == {2, 99}
    assert {r.path for r in catalog.select_all(known).where("selected").collect()} == {"/a", "/b", "/c", "/e"}


def test_snapshots_switch_at_once(spark, tmp_path):
    store = catalog.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.read("t") is None
    store.write({"t": spark.range(3), "u": spark.range(1)})
    old = store.read("t")
    store.write({"t": old.union(spark.range(2))})
    assert store.read("t").count() == 5 and old.count() == 3 and store.read("u").count() == 1


def test_vectors_fill_up_with_zero_and_negative_cosines(spark):
    """Fewer positive chunks than the cap: the smallest ids without a cosine follow, then negative ones."""
    rng = random.Random(5)
    texts = ["alpha beta " + " ".join(f"w{rng.randrange(900)}" for _ in range(30)) for _ in range(40)] + [" ".join(f"v{rng.randrange(900)}" for _ in range(20)) for _ in range(200)] + ["", ""]
    chunks = corpus(spark, [(1, texts[:150]), (2, texts[150:])])
    ix = search.Index.over(chunks)
    reqs = search.requests(spark, {"a": "alpha beta w1 w2", "b": "", "c": "nowhere"})
    docs = chunks.select("document_id").distinct()
    got = search.vector(reqs, ix, docs).orderBy("query_id", "rank").collect()
    q = {(r.query_id, r.dim): r.value for r in index.hash_vectors(reqs, "query_id", F.col("query")).collect()}
    dots = {}
    for r in ix.vectors.collect():
        for name in "abc":
            if (name, r.dim) in q:
                dots[name, r.chunk_id] = dots.get((name, r.chunk_id), 0.0) + r.value * q[name, r.dim]
    ids = [r.chunk_id for r in chunks.collect()]
    for name in "abc":
        want = sorted((-round(dots.get((name, c), 0.0), 6), c) for c in ids)[: search.VECTOR_CAP]
        assert [(r.chunk_id, r.rank) for r in got if r.query_id == name] == [(c, k) for k, (_, c) in enumerate(want, 1)]
        assert all(abs(r.score + s) < 2e-6 for r, (s, _) in zip((r for r in got if r.query_id == name), want, strict=True))

"""Each registered query that has no SQL, on a small folder, against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessella.llm import bpe, queries
from tests.llm.test_classifiers import junk, prose, toxic
from tests.llm.test_packing import best_fit, check
from tests.llm.test_simhash import fingerprint, groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _block int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [junk(rng, 50) if k % 5 == 0 else toxic(rng, 120) if k % 5 == 1 else prose(rng, rng.randint(1, 200)) for k in range(700)]
    texts += texts[3:9] + [" ".join(texts[12].split()[:-1]), texts[13].upper(), "", None, None, "a", "<|endoftext|> naïve 漢字\n\n  x", "é" * 3000, prose(rng, 12_000)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", 1) for d, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d % 5 != 0), int(d % 5 == 1)) for d in range(700)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def got(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def test_op1(spark, folder, rows):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted(map(tuple, got(spark, folder, "op1_bpe_roundtrip"))) == want


def test_op2(spark, folder, rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = [len(e.ids) for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]
    want = [(d, len((x or "").encode()), k, k > 512) for (d, x), k in zip(rows, n, strict=True)]
    assert sorted(map(tuple, got(spark, folder, "op2_token_counts"))) == want


@pytest.mark.parametrize(("name", "mod", "held", "threshold", "column"), [("op6_quality", 3, 1, 0.5, "quality"), ("op8_toxicity", 4, 2, 0.3, "toxic")])
def test_op6_and_op8(spark, folder, rows, name, mod, held, threshold, column):
    out = {r.doc_id: r for r in got(spark, folder, name)}
    assert sorted(out) == [d for d, _ in rows]
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % mod == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    right = [out[d].predicted == (int(d % 5 != 0) if column == "quality" else int(d % 5 == 1)) for d in range(700) if out[d].held_out]
    assert np.mean(right) > 0.93
    by_text = {}
    for d, t in rows:  # only the text is an input
        assert by_text.setdefault(t or "", out[d].score) == pytest.approx(out[d].score, abs=1e-5)  # sums differ with the batch


def test_op7(spark, folder, rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = got(spark, folder, "op7_best_fit_packing")
    want, lengths = [], []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            piece = ids[start : start + 2048]
            lengths.append(len(piece))
            want.append((d, k, start, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert check(out, 2048) <= best_fit(lengths, 2048)


def test_op10(spark, folder, rows):
    fps = [fingerprint(t) for _, t in rows]
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    out = sorted(map(tuple, got(spark, folder, "op10_simhash")))
    assert out == [(d, f"{fps[d]:016x}", root[d]) for d, _ in rows]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in queries.QUERIES:
        if name not in ("op4_topk", "op5_embedding_dedup", "op9_warc"):
            assert got(spark, str(tmp_path), name) == []


def test_repeated_ids_and_order_change_no_score(spark, folder, rows, tmp_path):
    """Of a repeated id the least text is learnt from, in whatever order rows come."""
    extra = [(d, "zz " * 30, "en", "s", 90, "c", 1) for d in range(0, 60, 7)]
    all_rows = [(d, t, "en", "s", len(t or ""), "clash", 1) for d, t in rows] + extra
    scores = []
    for k, order in enumerate((all_rows, all_rows[::-1])):
        spark.createDataFrame(order, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in got(spark, f"{tmp_path}/{k}", "op6_quality")))
    assert scores[0] == scores[1]

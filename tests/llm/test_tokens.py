import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = " \n\t\r'stdlmrevABC xyz019.,!?<|endoftext|>éß²漢字😀　\u0085​\x1c\x1f ́İ"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.from_ranks(bpe.read_ranks(RANKS)), P.PATTERN)


@pytest.fixture(scope="module")
def counter():
    return tokens._counter(P.path("byte_bpe_50k.json"), P.PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.packed(text), np.uint32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(LETTERS), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    e = _shared["encoder"]
    assert ids(e, text) == _shared["library"].encode_ordinary(text)


_shared: dict = {}


@pytest.fixture(autouse=True, scope="module")
def _share(library, encoder):
    _shared.update(library=library, encoder=encoder)


def test_long_pieces_and_small_tables_encode_alike(library):
    small = bpe.Encoder(bpe.Vocabulary.from_ranks(bpe.read_ranks(RANKS)), P.PATTERN)
    small.transducer.max_states, small.known.limit = 50, 10
    for text in ["a" * 3000, "ab" * 700, " " * 999, "thereadingword" * 90, "!?" * 400]:
        assert ids(small, text) == library.encode_ordinary(text)


@pytest.mark.parametrize("window", [1, 2, 3, 1000])
def test_streams_decode_at_any_window(library, encoder, window):
    text = "naïve 漢字 😀 ß" * 5
    stream = bpe.decode_stream(encoder.transducer.v.bytes, library.encode_ordinary(text), window)
    assert "".join(stream) == text


@given(st.binary(max_size=30), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_utf8_machine_is_the_decoder(data, step):
    s = bpe.Utf8Stream()
    valid = data.decode("utf-8", "ignore").encode()
    assert "".join([*(s.feed(valid[i : i + step]) for i in range(0, len(valid), step)), s.close()]) == valid.decode()


def test_counts_and_chunk_maps(counter):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>  b<|endoftext|>\n", "x" * 500, " \n" * 200]
    texts += ["a" * 5000, "=" * 3000 + "-" * 3001, " " * 4000 + "x", "abc" * 1500, "漢字仮名" * 700, "".join(rng.choice("acgt") for _ in range(9000)), "thereadingword" * 300]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    for chunk, look in ((3, 2), (7, 0), (128, 64), (128, 4)):
        counter.chunk, counter.look = chunk, look
        assert counter.totals(texts).tolist() == want
        assert [counter.total(x) for x in texts[:40]] == want[:40]
    counter.chunk, counter.look = 128, 64
    assert counter.totals([]).tolist() == [] and counter.totals([None, ""]).tolist() == [0, 0]


def test_maps_of_stretches_compose(counter):
    """From any state, a stretch does what its two halves do one after the other."""
    text = "the reading of words, 漢字 and numbers 1234 " * 3
    data = np.frombuffer(text.encode(), np.uint8)
    marks = np.zeros(len(data), bool)
    counter.total(text)
    states = np.random.default_rng(0).integers(0, len(counter.table.objects), 200)
    n = np.full(200, len(data))
    for half in (1, 20, 77):
        whole = counter.table.run(data, marks, 0 * n, n, states)
        a, between = counter.table.run(data, marks, 0 * n, 0 * n + half, states)
        b, after = counter.table.run(data, marks, 0 * n + half, n - half, between)
        assert (whole[0] == a + b).all() and (whole[1] == after).all()


def test_small_tables_count_alike():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = tokens.Counter(tokens.read_json(P.path("byte_bpe_50k.json"))[0], P.PATTERN, [])
    own.table.max_states = 5
    for text in ("some words " * 30, "other ones " * 40, "z" * 700):
        assert own.total(text) == len(t.encode(text, add_special_tokens=False).ids)


ROWS = [(1, "One text.", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "naïve 漢字", "z"), (4, "word " * 30_000, "w")]


def test_frames_keep_rows_and_columns(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, decoded string").repartition(2)
    rows = tokens.round_trip(df, RANKS, P.PATTERN).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    again = tokens.decode(tokens.encode(df, RANKS, P.PATTERN).withColumn("ids", F.when(F.col("doc_id") == 1, F.lit(None)).otherwise(F.col("ids"))), RANKS)
    assert {r.doc_id: r.decoded for r in again.collect()}[1] is None
    counted = tokens.token_counts(df.withColumn("n_tokens", F.lit("old")), P.path("byte_bpe_50k.json"), P.PATTERN)
    assert counted.columns == ["doc_id", "text", "decoded", "n_tokens"]
    assert {r.n_tokens for r in counted.where("coalesce(text, '') = ''").collect()} == {0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.round_trip(df, RANKS, P.PATTERN).collect() == []
    assert tokens.token_counts(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []

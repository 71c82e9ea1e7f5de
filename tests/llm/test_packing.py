import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import packing

PATH = P.path("word_bpe_49k.json")


def check(rows, capacity):
    """Sequences are gapless and hold no more than they can; gives their number."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_the_plan_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 5, 17, 33, 50, 51, 64, 99, 100]) if seed % 2 else rng.randint(1, 100) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots = packing.plan(counts, 100)
    used = {}
    for length, low, high, first, each, base in slots:
        for rank in range(low, high):
            used.setdefault(first + (rank - low) // each, []).append((base + (rank - low) % each * length, length))
    assert sum(map(len, used.values())) == len(lengths)
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    assert len(used) == best_fit(lengths, 100)


def test_a_histogram_of_billions_is_planned_at_once():
    slots = packing.plan({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert sum(high - low for _, low, high, *_ in slots) == sum(10**9 + n for n in range(1, 2049)) and len(slots) < 200_000


def test_ids_as_the_library(spark):
    t, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH, limit=20)
    rng = random.Random(3)
    letters = " \n\t\r'sStTrReEvV ABCxyz019.,!?<|éÉßÀµªº²½ÿ×÷\u0085\xa0\x1c漢ſΣ"
    for _ in range(800):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "İ", "<|ENDOFTEXT|>"])
        assert np.frombuffer(ids.packed(s), np.uint32).tolist() == t.encode(s, add_special_tokens=False).ids


def test_every_latin_1_character_is_cut_as_the_tokenizer_cuts():
    t, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(8)
    every = [chr(c) for c in range(256)]
    texts = ["a".join(every), " ".join(every), "'".join(every), "".join(every) * 2]
    texts += ["".join(rng.choices(every, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("aZ\xc9\xdf'sSvVeErRlLdDmMtT1\xb2\xbd \xa0\x85\xad!", k=rng.randint(1, 30))) for _ in range(3000)]
    texts += [x + " \u00e9\u0301\u4e2d" for x in texts[::50]]  # words known from one kind of text in the other
    for x in texts:
        assert np.frombuffer(ids.packed(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_documents(spark):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = [None, "", "one", "same text here", "same text here", "a b " * 3000] + [" ".join(rng.choice(["the", "word", "éclair", "12"]) for _ in range(rng.randint(1, 90))) for _ in range(200)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(3, "same text here"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("piece", F.lit(0))
    got = packing.pack_documents(df, PATH, capacity=64).collect()
    want = []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], np.uint32)
        want += [(d, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    n = check(got, 64)
    assert math.ceil(sum(w[3] for w in want) / 64) <= n <= best_fit([w[3] for w in want], 64)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []

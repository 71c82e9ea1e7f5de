import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import warc
from tessella.llm.common import scratch_path


def run(spark, rows, least=0, **more):
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("first", F.lit(1))
    warc.write_archives(df, path, least, **more)
    return path, warc.read_archives(spark, path).collect()


def plain(rows, least=0):
    out, first = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= least and data in first
        first.setdefault(data, i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def found(got):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [(3, "http://a/é", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, None), (4, "bad\r\nWARC-Type: x", ""), (5, "u", FAKE), (6, "u", "text\r\n\r\n" + FAKE * 3 + "WARC/1.1\r\n"), (7, "u", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (8, "u", "漢字" * 40_000), (9, "u", "<p>same</p>"), (None, "u", "no id"), (10, "u", FAKE), (-5, "u", "\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 12])
def test_pages_come_back(spark, least):
    rows = ROWS
    _, got = run(spark, rows, least)
    assert found(got) == plain(rows, least)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_every_row_has_a_record(spark):
    """Null ids, ids of 19 digits, one id with several payloads, and rows that are equal throughout."""
    top = 2**63 - 1
    rows = [(10**18, "u", "a"), (5, "u", "a"), (None, "u", "a"), (5, "v", "b"), (2 * 10**18, "u", "b"), (top, "u", "c"), (-top, "u", "c"), (None, "u", "d"), (None, "u", "d"), (None, "v", "d"), (None, None, None), (None, None, "")]
    rows += [(7, "u", "same")] * 40 + [(7, "w", "same"), (8, "u", "same")]
    _, got = run(spark, rows)
    assert found(got) == plain(rows)
    assert sum(r.record_type == "response" for r in got) == 6


def test_payloads_full_of_magic(spark):
    heads = "WARC/1.1\r\n" * 3000 + "\r\nContent-Length: 7\r\n" + "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 2000
    rows = [(1, "u", heads), (2, "u" * 100_000, "x" + heads), (3, "u", "漢" * 1_500_000), (4, "u", heads)]
    _, got = run(spark, rows)
    assert found(got) == plain(rows)


def test_candidates_do_not_depend_on_pieces():
    record = FAKE.encode()
    data = record * 3 + b"WARC/1.1\r\nX: 1\r\n\r\n" + record + b"WARC/1.1\r\nContent-Length: 4"
    whole = warc.candidates([data])
    assert len(whole[0]) == 4 and whole[1] == len(data)
    for n in (1, 3, 17, 64):
        assert warc.candidates(data[i : i + n] for i in range(0, len(data), n)) == whole
    ranges = [(a, b) for a, b in whole[0][:3]]
    assert list(warc.records((data[i : i + 5] for i in range(0, len(data), 5)), ranges)) == [record] * 3


def test_many_equal_pages_over_many_files(spark):
    rows = [(i, "u", "same") for i in range(500)]
    path, got = run(spark, rows, per_file=40)
    assert found(got) == plain(rows)
    files = [f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".gz")]
    assert len(files) > 4
    with gzip.open(f"{path.removeprefix('file://')}/{files[0]}") as f:
        data = f.read()
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_damage_is_noticed(spark):
    path, _ = run(spark, [(i, "u", f"page {i}") for i in range(5)])
    folder = path.removeprefix("file://")
    name = next(f for f in os.listdir(folder) if f.endswith(".gz") and gzip.open(f"{folder}/{f}").read())
    with gzip.open(f"{folder}/{name}") as f:
        data = f.read()
    with gzip.open(f"{folder}/{name}", "wb") as f:
        f.write(data[:-7])
    os.path.exists(f"{folder}/.{name}.crc") and os.remove(f"{folder}/.{name}.crc")
    with pytest.raises(Exception, match="chain|damaged"):
        warc.read_archives(spark, path).collect()


def test_pointer_jumping():
    rng = np.random.default_rng(0)
    chain = np.concatenate([[0], np.cumsum(rng.integers(20, 60, 300))])
    false = rng.integers(1, chain[-1], 200)
    false = np.setdiff1d(false, chain)
    offsets = np.concatenate([chain[:-1], false])
    successors = np.concatenate([chain[1:], false + rng.integers(1, 90, len(false))])
    by = rng.permutation(len(offsets))
    keep = warc.reachable(offsets[by], successors[by], chain[-1])
    assert sorted(offsets[by][keep].tolist()) == chain[:-1].tolist()


def test_empty_table(spark):
    assert run(spark, [])[1] == []

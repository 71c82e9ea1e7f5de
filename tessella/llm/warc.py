"""Operator 9: WARC archives with revisit records, read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialise, scratch_path, slices, table

VERSION = b"WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RESPONSE = "urn:payload:sha1:"


def _base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, kind: str, named: bool, first: int | None) -> str:
    """One record without its closing blank lines. size is the payload's; a revisit has no payload.

    named: the record is the response of its payload, to which revisits refer by the payload's digest.
    """
    again = kind == "revisit"
    http = HTTP.format(n=size)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{RESPONSE}{digest}>" if named else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if again else size)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if again:
        head += [f"WARC-Refers-To: <{RESPONSE}{digest}>", f"WARC-Profile: {PROFILE}"]
        if first is not None:
            head.append(f"Refers-To-Page-ID: {first}")
    return "\r\n".join(head) + "\r\n\r\n" + http + ("" if again else html)


def write_archives(pages: DataFrame, path: str, least: int = 0, per_file: int = 2000) -> None:
    """Writes a record for each row of pages (page_id, url, html) to gzipped files at path, through Spark's own text writer.

    The file format's record terminator is the writer's line separator, so each row is a record, and
    lost tasks and failed attempts leave no partial files. Of rows whose payloads are equal and have
    at least `least` bytes, that of the least page_id is the response (a null id comes last, then the
    least url counts); the others become revisits of it. It is found by aggregations of ids and urls,
    pre-aggregated in each task, and joined back.

    Every row has its record: rows without an id, rows of one id, and rows that are equal throughout,
    of which one is a response and the others revisit it. A null html is an empty payload.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    seen = keyed.where(F.col("size") >= least).groupBy("sha", "page_id", "url").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "n")
    firsts = materialise(seen.groupBy("sha").agg(F.min(order).alias("first")).select("sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), F.col("first.n").alias("twins")), "payloads")
    rows = keyed.join(firsts, "sha", "left")
    chosen = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    grouped = F.col("twins").isNotNull()
    kind = F.when(grouped & ~chosen, "revisit").otherwise("response")
    columns = ["page_id", "url", "html", "sha", "size", "kind", "named", "first"]
    out = rows.where(~(grouped & chosen & (F.col("twins") > 1))).select(*columns[:5], kind.alias("kind"), (grouped & chosen).alias("named"), "first")
    if not firsts.where("twins > 1").isEmpty():  # rows equal throughout: one response, and the others in blocks of bounded size
        same = keyed.join(firsts.where("twins > 1"), "sha").where(chosen)
        one = same.groupBy("sha", "size", "first", "first_url", "twins").agg(F.max("html").alias("html"))
        response = one.select(F.col("first").alias("page_id"), F.col("first_url").alias("url"), "html", "sha", "size", F.lit("response").alias("kind"), F.lit(True).alias("named"), "first")
        blocks = firsts.where("twins > 1").join(one.select("sha", "size"), "sha").select("*", F.explode(F.sequence(F.lit(1), "twins", F.lit(10_000))).alias("at")).where("at < twins").repartition("sha", "at")
        others = blocks.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(9_999), F.col("twins") - 1 - F.col("at")))))
        revisits = others.select(F.col("first").alias("page_id"), F.col("first_url").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "size", F.lit("revisit").alias("kind"), F.lit(False).alias("named"), "first")
        out = out.unionByName(response).unionByName(revisits)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = zip(*(b.column(n).to_pylist() for n in columns), strict=True)
            yield pa.RecordBatch.from_pydict({"value": [_record(i, u, h, _base32(s), n, k, m, f) for i, u, h, s, n, k, m, f in rows]})

    text = out.withColumn("html", F.when(F.col("kind") == "response", F.col("html"))).select(*columns).mapInArrow(records, "value string")
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    discard(firsts)


_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n")
_BLANK = re.compile(rb"\r\n\r\n")


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a gzip file, which may have several members, a piece at a time."""
    while data:
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            piece = member.decompress(data, step)
            data = member.unconsumed_tail
            if not piece and not data and not member.eof:
                raise ValueError("the chain of records doesn't reach the end of the file: its last member is cut")
            yield piece
        data = member.unused_data


class _Next:
    """The next match of a pattern at or after a place; each stretch is searched once."""

    def __init__(self, pattern: re.Pattern):
        self.pattern, self.start, self.match, self.upto = pattern, 0, None, -1

    def after(self, data: bytes, at: int) -> re.Match | None:
        if self.match is None or self.match.start() < at:
            self.match = self.pattern.search(data, max(at, self.start))
            if self.match is None:
                self.start = max(at, len(data) - 64)
        return self.match


def candidates(pieces: Iterable[bytes]) -> tuple[list[tuple[int, int]], int]:
    """(offset, successor) wherever the magic stands, in payloads as well: where a record that began there would end; and the size of it all.

    Holds what lies between a magic and the next blank line, and searches no stretch twice, however
    many magics a payload has.
    """
    out, base, held = [], 0, b""
    pieces = iter(pieces)
    more = True
    while more:
        piece = next(pieces, None)
        more = piece is not None
        held += piece or b""
        blanks, lengths = _Next(_BLANK), _Next(_LENGTH)
        at = held.find(VERSION)
        keep = max(0, len(held) - len(VERSION) + 1)
        while at >= 0:
            blank = blanks.after(held, at)
            if blank is None:
                keep = at
                break
            length = lengths.after(held, at)
            if length is not None and length.end() <= blank.start() + 2:
                out.append((base + at, base + blank.end() + int(length[1]) + len(END)))
            at = held.find(VERSION, at + 1)
        if more:
            held, base = held[keep:], base + keep
    return out, base + len(held)


def records(pieces: Iterable[bytes], ranges: Iterable[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each range, in order; no more than one of them and a piece is held."""
    pieces, base, held = iter(pieces), 0, b""
    for start, end in ranges:
        parts, have = [held], base + len(held)
        while have < end:
            parts.append(next(pieces))
            have += len(parts[-1])
        held = b"".join(parts)
        yield held[start - base : end - base]
        held, base = held[end - base :], end


def reachable(offsets: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping: rounds double the length of jumps.

    Raises if the chain stops before the end of the file.
    """
    order = np.argsort(offsets)
    starts = offsets[order]
    place = np.searchsorted(starts, successors[order])
    end = len(starts)
    hit = (place < end) & (starts[np.minimum(place, end - 1)] == successors[order])
    jump = np.append(np.where(hit, place, end), end)
    seen = np.zeros(end + 1, bool)
    seen[0] = bool(end) and starts[0] == 0
    while True:
        more = seen.copy()
        more[jump[np.flatnonzero(seen)]] = True
        if (more == seen).all() and (jump == jump[jump]).all():
            break
        seen, jump = more, jump[jump]
    chain = np.flatnonzero(seen[:end])
    if size and (not len(chain) or successors[order][chain].max() != size):
        raise ValueError("the chain of records doesn't reach the end of the file")
    out = np.zeros(len(offsets), bool)
    out[order[chain]] = True
    return out


def _field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return m[1].decode() if m else None


def _number(text: str | None) -> int | None:
    if text is None:
        return None
    if not re.fullmatch(r"-?\d{1,19}", text):
        raise ValueError(f"a record on the chain has no readable page id: {text[:40]}")
    return int(text)


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _parse(data: bytes) -> tuple:
    """The fields of one whole record. Raises if it is damaged: a response's digest must be that of its payload."""
    blank = data.index(b"\r\n\r\n")
    head, block = data[: blank + 2], data[blank + 4 : -len(END)]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = _field(head, b"WARC-Type"), (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
    sound, size = data.endswith(END.encode()), len(payload)
    if kind == "response":
        sound &= base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    else:
        declared = _LENGTH.search(b"\r\n" + http + b"\r\n")
        size, payload = int(declared[1]) if declared else None, None
    if not sound:
        raise ValueError(f"a record on the chain is damaged: {_field(head, b'WARC-Record-ID')}")
    return _number(_field(head, b"Page-ID")), size, digest, kind, _number(_field(head, b"Refers-To-Page-ID")), _field(head, b"WARC-Target-URI"), payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record in the files at path.

    A file's task goes through it twice: first it notes every candidate with its successor, offsets
    only, and keeps those that the chain from the file's start reaches; then only these are cut out,
    digested and parsed. A payload may hold the magic, whole records even: no chain leads into it. A
    worker holds a compressed file and one record. A response's digest must be the one in its header,
    and a page id must be readable, or an error is raised. A revisit's payload is null; its size is
    the one that its HTTP header declares.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            content = b.column("content")[0].as_py()
            pairs, size = candidates(inflated(content))
            at, successor = np.array(pairs, np.int64).reshape(-1, 2).T
            chain = reachable(at, successor, size)
            rows, held = [], 0
            for data in records(inflated(content), np.stack([at, successor], axis=1)[chain].tolist()):  # in order, as candidates are
                row = _parse(data)
                rows.append(row if payloads else (*row[:-1], None))
                held += len(data) if payloads else 100
                if held > 1 << 22:
                    yield _batch(rows, fields)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, fields)

    return files.mapInArrow(read, FIELDS)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, first_value(page_id) OVER w AS first, row_number() OVER w AS nth
      FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth = 1 THEN NULL ELSE first END AS refers_to
FROM d
"""

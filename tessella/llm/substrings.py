"""Operator 3: removal of word passages that an earlier document has, by prefix-partitioned suffix trees.

Every suffix of every document begins with a window of `length` words, and only so much of a suffix
matters here. Documents are dealt into blocks of bounded size; then, in one plan:

1. Each block sends the hashes of its different windows, in ranges, as gaps of about two bytes. A
   range says which of them came from two documents. Equal windows have equal hashes, so this only
   drops suffixes that can't share a whole window; some unequal ones stay by chance.
2. The words of the suffixes that are left travel to their groups. Neighbouring windows of one anchor
   (the least hash of a few words inside) travel as one fragment, so that overlapping words are sent
   once, and equal windows meet, because they have equal anchors. A block sends equal fragments once,
   with the least id that has them: a passage that a third of all documents share costs its group one
   fragment a block.
3. A group's suffixes are split by word prefixes, longer where many begin alike, into subtrees of
   memory size. A subtree's leaves are sorted by their words, with the words that neighbours share;
   an internal node of depth `length` or more is a repeat, and its least id is that of its first
   document. Only words decide here, no hash.
4. Groups answer to blocks, a bit a window, and the blocks remove the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import table

ANCHOR_WORDS = 4
SPARE_BITS = 8  # a unique window stays a candidate with a probability of about 2^-8
NO_ID = np.iinfo(np.int64).max  # documents without an id come last
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sum(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many words, of all places at once."""
    n = len(h) - words + 1
    out, scale = np.zeros(max(0, n), np.uint64), np.uint64(1)
    if n > 0:
        with np.errstate(over="ignore"):
            for j in range(words):
                out += h[j : j + n] * scale
                scale *= _ODD
            out = _mix(out)
    return out


def window_starts(sizes: np.ndarray, length: int) -> np.ndarray:
    """Of documents laid end to end: the places at which a whole window begins."""
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0)
    return np.flatnonzero(left >= length)


def anchors(h: np.ndarray, length: int) -> np.ndarray:
    """For each place the least hash of a few words inside the window there."""
    few = min(ANCHOR_WORDS, length)
    least, span, want = _sum(h, few), 1, length - few + 1
    n = max(0, len(h) - length + 1)
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[want - span : want - span + n])


# --- which windows can repeat ----------------------------------------------------------------------


def pack(codes: np.ndarray, twice: np.ndarray) -> dict:
    """Ascending codes and a bit for each: gaps in byte planes, of which the high ones are mostly zeros."""
    planes = np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1
    return {"n": len(codes), "gaps": planes[:used].tobytes(), "bits": np.packbits(twice).tobytes()}


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    n = row["n"]
    planes = np.frombuffer(row["gaps"], np.uint8).reshape(-1, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(planes)] = planes.T
    return np.cumsum(wide.view(np.uint64)[:, 0], dtype=np.uint64), np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=n).astype(bool)


class Block:
    """Some documents, in the order of id and text, and the codes of their windows."""

    def __init__(self, t: pa.Table, doc_id: str, text: str, length: int, bits: int, ranges: int):
        # nulls last; rows equal in both are interchangeable, so each pass over a block finds the same places
        t = t.sort_by([(doc_id, "ascending"), (text, "ascending")])
        self.rows, self.length, self.ranges = t, length, ranges
        texts = t.column(text).to_pylist()
        self.words = [(x or "").encode().split() for x in texts]  # bytes.split() knows just these six separators
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ids = np.array([NO_ID if i is None else i for i in t.column(doc_id).to_pylist()], np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, int(self.sizes.sum()))
        self.at = window_starts(self.sizes, length)
        self.owner = np.repeat(self.ids, self.sizes)[self.at]
        self.codes = _sum(self.hashes, length)[self.at] >> np.uint64(64 - bits)
        self.unique, self.nth = np.unique(self.codes, return_inverse=True)
        # equal widths of the code space; the last one takes the remainder
        edges = np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64)
        self.cuts = np.concatenate([[0], np.searchsorted(self.unique, edges), [len(self.unique)]])

    def cells(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each range that has some: its number, the codes, and whether two ids here have them."""
        first, last = np.full(len(self.unique), NO_ID), np.full(len(self.unique), np.iinfo(np.int64).min)
        np.minimum.at(first, self.nth, self.owner)
        np.maximum.at(last, self.nth, self.owner)
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            a, b = self.cuts[k], self.cuts[k + 1]
            yield k, self.unique[a:b], first[a:b] != last[a:b]

    def fragments(self, marks: list[dict], groups: int) -> dict[int, tuple[list[bytes], list[list[int]]]]:
        """By group: the different fragments, in the order in which they first occur, and their places, as numbers of windows."""
        marked = np.zeros(len(self.unique), bool)
        for row in marks:
            a, b = self.cuts[row["part"]], self.cuts[row["part"] + 1]
            marked[a:b] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a)
        found = np.flatnonzero(marked[self.nth])
        if not len(found):
            return {}
        anchor = anchors(self.hashes, self.length)[self.at[found]]
        broken = np.append(True, (np.diff(self.at[found]) != 1) | (np.diff(anchor) != 0))
        starts = np.flatnonzero(broken)
        counts = np.diff(np.append(starts, len(found)))
        group = (_mix(anchor[starts]) % np.uint64(groups)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(self.sizes)])
        place = self.at[found[starts]]
        doc = np.searchsorted(base, place, side="right") - 1
        offset = place - base[doc]
        out: dict[int, tuple[list[bytes], list[list[int]]]] = {}
        known: dict[bytes, list[int]] = {}
        for w, d, o, c, g in zip(found[starts].tolist(), doc.tolist(), offset.tolist(), counts.tolist(), group.tolist(), strict=True):
            data = b" ".join(self.words[d][o : o + c + self.length - 1])
            if data in known:
                known[data].append(w)
            else:
                known[data] = places = [w]
                texts, all_places = out.setdefault(g, ([], []))
                texts.append(data)
                all_places.append(places)
        return out


# --- subtrees ----------------------------------------------------------------------------------------


def split_by_prefixes(tokens: np.ndarray, leaves: np.ndarray, length: int, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """Leaves in groups that share a prefix: (leaves, how many words they are known to share).

    A prefix that over `limit` leaves begin with is made longer by a word; neighbouring prefixes that
    few begin with stay together. Leaves that share all of a window are one group, however many.
    """
    todo = [(leaves, 0)]
    while todo:
        leaves, depth = todo.pop()
        if len(leaves) <= limit or depth == length:
            yield leaves, depth
            continue
        word = tokens[leaves + depth]
        by = np.argsort(word, kind="stable")
        leaves, word = leaves[by], word[by]
        ends = np.append(np.flatnonzero(word[1:] != word[:-1]) + 1, len(leaves)).tolist()
        start = last = 0
        for end in ends:
            if end - start > limit and last > start:
                todo.append((leaves[start:last], depth))
                start = last
            if end - start > limit:
                todo.append((leaves[start:end], depth + 1))
                start = end
            last = end
        if last > start:
            todo.append((leaves[start:last], depth))


class Subtree:
    """The suffixes that share a prefix, in the order of their words, cut at `length` words.

    shared[i] is how many words leaf i has in common with the one before; a run of leaves that share
    at least length words is a node of full depth, a repeat as long as a window or longer.
    """

    def __init__(self, tokens: np.ndarray, leaves: np.ndarray, depth: int, length: int):
        columns = [tokens[leaves + k] for k in range(depth, length)]
        order = np.lexsort(columns[::-1]) if columns else np.arange(len(leaves))
        self.leaves = leaves[order]
        self.shared = np.full(len(leaves), depth)
        self.shared[:1] = 0
        same = np.ones(max(0, len(leaves) - 1), bool)
        for c in columns:
            c = c[order]
            same &= c[1:] == c[:-1]
            self.shared[1:] += same
        self.nodes = np.flatnonzero(self.shared < length)  # where each begins

    def least(self, ids: np.ndarray) -> np.ndarray:
        """For each leaf, in the order of leaves, the least of the ids below its deep node."""
        if not len(self.leaves):
            return ids
        return np.repeat(np.minimum.reduceat(ids, self.nodes), np.diff(np.append(self.nodes, len(self.leaves))))


def first_ids(texts: list[bytes], ids: np.ndarray, length: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each fragment, laid end to end, the least id that has it; and where each fragment's windows begin.

    ids: of each fragment, the least that has it.
    """
    number: dict[bytes, int] = {}
    words = [t.split(b" ") for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    tokens = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), np.int32, int(sizes.sum()))
    del number, words
    leaves = window_starts(sizes, length)
    counts = sizes - length + 1
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.zeros(len(tokens), np.int64)  # from a place to the number of its window
    at[leaves] = np.arange(len(leaves))
    owner = np.repeat(ids, counts)
    out = np.empty(len(leaves), np.int64)
    for some, depth in split_by_prefixes(tokens, leaves, length, limit):
        tree = Subtree(tokens, some, depth, length)
        nth = at[tree.leaves]
        out[nth] = tree.least(owner[nth])
    return out, begin


ROW = "_block long, part int, n int, gaps binary, bits binary, ids binary"
SENT = pa.schema([("_block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("gaps", pa.binary()), ("bits", pa.binary()), ("ids", pa.binary())])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 13, block_chars: int = 4_000_000, group_windows: int = 2_000_000, subtree_leaves: int = 200_000, bits: int | None = None) -> DataFrame:
    """Removes each word that lies in a window of `length` words with which a document of smaller id also has a window.

    Windows are judged on the input. Returns the rows with text replaced by the kept words, joined
    by single spaces, and two more columns: n_words and n_removed (long). Words are runs of anything
    but space and U+0009 to U+000D. A null text has no words and becomes empty; texts shorter than a
    window keep all. Rows of equal id don't remove each other's words, only an id that is smaller
    does; a null id counts as larger than all. An empty table gives an empty table. Columns named
    n_words, n_removed or _block are replaced.

    Blocks are dealt by id and text, so rows of one id or without an id are spread as their texts
    differ. `bits` of window hashes, by default some more than the number of windows needs, decide
    how much is sent, never what is removed. The other sizes bound a task's memory.
    """
    spark = df.sparkSession
    df = df.drop("n_words", "n_removed", "_block")
    chars = df.agg(F.sum(F.length(text).cast("double"))).first()[0] or 0.0
    least = 2 * spark.sparkContext.defaultParallelism
    blocks, parts = (max(math.ceil(chars / size), least) for size in (block_chars, 6.0 * group_windows))
    bits = bits or min(64, max(24, math.ceil(math.log2(chars / 6 + 1)) + SPARE_BITS))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)))
    block = lambda t: Block(t, doc_id, text, length, bits, parts)

    def rows(out: list[dict]) -> pa.Table:
        pa.default_memory_pool().release_unused()
        return pa.Table.from_pylist(out, schema=SENT)

    def send(t: pa.Table) -> pa.Table:
        name = t.column("_block")[0].as_py()
        return rows([{"_block": name, "part": k} | pack(codes, twice) for k, codes, twice in block(t).cells()])

    def mark(t: pa.Table) -> pa.Table:
        part, names = t.column("part")[0].as_py(), t.column("_block").to_pylist()
        cells = [unpack(row) for row in t.select(["n", "gaps", "bits"]).to_pylist()]
        codes, twice = (np.concatenate(x) for x in zip(*cells, strict=True))
        order = np.argsort(codes, kind="stable")
        equal = codes[order[1:]] == codes[order[:-1]]
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        # of one code in two blocks of which neither has it twice, both are marked; a mark is for all equal ones
        out, end = [], 0
        for name, (c, _) in zip(names, cells, strict=True):
            end += len(c)
            some = twice[end - len(c) : end]
            if some.any():
                out.append({"_block": name, "part": part, "n": -1, "bits": np.packbits(some).tobytes()})
        return rows(out)

    def ship(t: pa.Table, marks: pa.Table) -> pa.Table:
        if not t.num_rows or not marks.num_rows:
            return rows([])
        b, out = block(t), []
        for g, (texts, places) in b.fragments(marks.select(["part", "bits"]).to_pylist(), parts).items():
            ids = b.owner[[p[0] for p in places]]
            out.append({"_block": t.column("_block")[0].as_py(), "part": g, "n": len(texts), "gaps": b"\n".join(texts), "ids": ids.tobytes()})
        return rows(out)

    def grow(t: pa.Table) -> pa.Table:
        names, counts = t.column("_block").to_pylist(), t.column("n").to_pylist()
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(x, len(number)) for data in t.column("gaps").to_pylist() for x in data.split(b"\n")], np.int64)
        mine = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()])
        least = np.full(len(number), NO_ID)
        np.minimum.at(least, which, mine)
        first, begin = first_ids(list(number), least, length, subtree_leaves)
        del number
        out, end = [], 0
        for name, n in zip(names, counts, strict=True):
            some, ids = which[end : end + n], mine[end : end + n]
            end += n
            windows = begin[some + 1] - begin[some]
            at = np.arange(windows.sum()) + np.repeat(begin[some] - (np.cumsum(windows) - windows), windows)
            out.append({"_block": name, "part": t.column("part")[0].as_py(), "n": n, "bits": np.packbits(first[at] < np.repeat(ids, windows)).tobytes()})
        return rows(out)

    def keep(t: pa.Table, answers: pa.Table) -> pa.Table:
        b = block(t)
        late = np.zeros(len(b.at), bool)
        if answers.num_rows:
            told = answers.select(["part", "n", "bits"]).to_pylist()
            found = b.fragments([row for row in told if row["n"] < 0], parts)
            for row in told:
                if row["n"] > 0:
                    texts, places = found[row["part"]]
                    windows = np.array([x.count(b" ") + 2 - length for x in texts])
                    bit = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(windows.sum())).astype(bool)
                    times = np.array([len(p) for p in places])
                    of = np.repeat(np.arange(len(texts)), times)  # the fragment of each occurrence
                    at = np.fromiter(chain.from_iterable(places), np.int64, int(times.sum()))
                    again = b.owner[at] > b.owner[[p[0] for p in places]][of]  # an earlier document of this block has all of it
                    size, begin = windows[of], (np.cumsum(windows) - windows)[of]
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    late[np.repeat(at, size) + step] = np.repeat(again, size) | bit[np.repeat(begin, size) + step]
        edges = np.zeros(len(b.hashes) + 1, np.int32)
        np.add.at(edges, b.at[late], 1)
        np.add.at(edges, b.at[late] + length, -1)
        covered = np.cumsum(edges[:-1]) > 0
        ends = np.cumsum(b.sizes)
        removed = np.add.reduceat(np.append(covered, False), np.minimum(ends - b.sizes, len(covered)), dtype=np.int64) * (b.sizes > 0) if len(ends) else ends
        kept = []
        for w, end, n, gone in zip(b.words, ends, b.sizes, removed, strict=True):
            kept.append(b" ".join(w if not gone else [x for x, c in zip(w, covered[end - n : end].tolist(), strict=True) if not c]).decode())
        t, sizes = b.rows, b.sizes
        del b
        pa.default_memory_pool().release_unused()
        t = t.set_column(t.schema.get_field_index(text), text, pa.array(kept, pa.string())).drop_columns(["_block"])
        return t.append_column("n_words", pa.array(sizes)).append_column("n_removed", pa.array(removed))

    result = T.StructType([*(f for f in dealt.schema.fields if f.name != "_block"), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    slim = dealt.select(doc_id, text, "_block").groupBy("_block")
    marks = slim.applyInArrow(send, ROW).groupBy("part").applyInArrow(mark, ROW)
    answers = slim.cogroup(marks.groupBy("_block")).applyInArrow(ship, ROW).groupBy("part").applyInArrow(grow, ROW)
    return dealt.groupBy("_block").cogroup(marks.unionByName(answers).groupBy("_block")).applyInArrow(keep, result)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of earlier ones: doc_id, n_words, n_removed, kept_sha256."""
    return digest(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT win, min(doc_id) AS first FROM v GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN m USING (win) WHERE doc_id > first),
k AS (SELECT a.doc_id, count(g.p) AS n_removed, string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS kept
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

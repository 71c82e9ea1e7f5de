"""Splitting texts into chunks along headings. An ordered fold over lines, so one Python pass a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import CAPTION, REGULATION

TARGET, LIMIT = 1400, 2400
CHUNK_STRIDE = 1_000_000  # chunk_id = document_id * CHUNK_STRIDE + ordinal
_REGULATION, _CAPTION = re.compile(REGULATION), re.compile(CAPTION)
_MARKDOWN = re.compile(r"(#{1,6})(?:\s+(.*))?")


@dataclass(frozen=True)
class Chunk:
    content: str
    heading_path: str
    char_start: int
    char_end: int


class _Levels:
    """Headings by level; setting one forgets those below."""

    def __init__(self):
        self.names: list[str] = []

    def put(self, level: int, name: str) -> None:
        self.names = [*self.names[:level], *[""] * (level - len(self.names)), name]


def _regulation_level(line: str) -> int | None:
    """The level of the first of the marks that stands anywhere in a heading line, or the lowest; None for other lines."""
    if not (_REGULATION.match(line) or _CAPTION.match(line)):
        return None
    return next((k for k, mark in enumerate("章節款目条") if mark in line), 5)


def _markdown_level(line: str) -> tuple[int, str] | None:
    m = _MARKDOWN.fullmatch(line)
    if not m:
        return None
    name = re.sub(r"\s+#+$", "", (m[2] or "").strip())
    return (len(m[1]) - 1, name) if name else None


def lines_of(text: str) -> list[str]:
    """Lines with their ends; only U+000A ends one."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def sections(text: str, markdown: bool) -> Iterator[Chunk]:
    """A section runs from a heading to the next; blank text before a heading stays with what follows.

    Plain texts keep empty levels in the path; Markdown drops them, has two sets of levels and
    knows no headings inside fenced code.
    """
    outer, inner, fenced = _Levels(), _Levels(), False
    held, start, cursor, path = "", 0, 0, ""
    for line in lines_of(text):
        bare = line.strip()
        fence = markdown and bare.startswith(("```", "~~~"))
        mark = _markdown_level(bare) if markdown and not fenced and not fence else None
        level = None if fenced or fence or mark else _regulation_level(bare)
        if mark or level is not None:
            if held.strip():
                yield Chunk(held.strip(), path, start, start + len(held))
                held = ""
            if not held:
                start = cursor
            if mark:
                outer.put(*mark)
                inner = _Levels()
            else:
                inner.put(level, bare)
            names = [*outer.names, *inner.names]
            path = " > ".join(n for n in names if n.strip()) if markdown else " > ".join(names)
        elif not held:
            start = cursor
        held += line
        cursor += len(line)
        fenced ^= fence
    if held.strip():
        yield Chunk(held.strip(), path, start, start + len(held))


def split_long(section: Chunk, limit: int = LIMIT) -> Iterator[Chunk]:
    """Whole lines up to the limit; a longer line stays whole."""
    held, start, cursor = "", section.char_start, section.char_start
    for line in lines_of(section.content):
        if held and len(held) + len(line) > limit:
            yield replace(section, content=held.strip(), char_start=start, char_end=start + len(held))
            held, start = "", cursor
        held += line
        cursor += len(line)
    if held.strip():
        yield replace(section, content=held.strip(), char_start=start, char_end=start + len(held))


def pack(parts: Iterator[Chunk], target: int = TARGET, limit: int = LIMIT) -> Iterator[Chunk]:
    """Neighbouring sections together up to the target, unless their headings differ; long ones split."""
    held: Chunk | None = None
    for s in parts:
        if len(s.content) > limit:
            if held:
                yield held
            held = None
            yield from split_long(s, limit)
            continue
        if held and (len(held.content) + len(s.content) > target or (s.heading_path and held.heading_path and s.heading_path != held.heading_path)):
            yield held
            held = None
        held = replace(held, content=f"{held.content}\n\n{s.content}", char_end=s.char_end) if held else s
    if held:
        yield held


def chunk_text(text: str, markdown: bool = False) -> list[Chunk]:
    return list(pack(sections(text, markdown)))


def is_markdown(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("md", "markdown")


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of (document_id, path, text): chunk_id, document_id, ordinal, char_start, char_end, heading_path, content, content_hash, prev and next."""
    source = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text"), is_markdown(F.col("path")).alias("md"))

    names = ["document_id", "ordinal", "char_start", "char_end", "heading_path", "content"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def cut(b: pa.RecordBatch) -> Iterator[tuple]:
        for d, text, md in zip(*(b.column(n).to_pylist() for n in ("document_id", "text", "md")), strict=True):
            for k, c in enumerate(chunk_text(text, md)):
                yield d, k, c.char_start, c.char_end, c.heading_path, c.content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                for rows in batched(cut(b.slice(i, 100)), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = source.mapInArrow(run, "document_id long, ordinal long, char_start long, char_end long, heading_path string, content string")
    return linked(out.withColumn("chunk_id", F.col("document_id") * CHUNK_STRIDE + F.col("ordinal")).withColumn("content_hash", F.sha2("content", 256)))


def linked(chunks: DataFrame) -> DataFrame:
    """Adds the ids of the chunks before and after in the document."""
    w = W.partitionBy("document_id").orderBy("ordinal")
    return chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))

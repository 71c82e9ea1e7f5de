"""Retrieval in several rounds: corrective and fact-guided queries, merges of hits, focused chunks, concepts of the source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.concepts import GENERIC, content_concepts, heading_concepts
from tessella.functions.text import first_chars, is_broad, is_stop, matches_any, meaningful_terms, normalized, terms, trim
from tessella.operators.search import DIGITS, PER_DOCUMENT, REPEAT_FACTOR, diversify

# Fixed values
CORRECTIVE_QUERIES, CORRECTIVE_LIMIT, CORRECTIVE_HITS, CORRECTIVE_STEP, ENOUGH = 36, 8, 32, 0.015, 0.08
GUIDED_QUERIES, GUIDED_LIMIT, GUIDED_HITS, GUIDED_STEP = 40, 6, 64, 0.01
FOCUS_SIBLINGS, FOCUS_CHUNKS = 4, 96


def needs_correction(is_broad_: bool, seed_scores: list[float]) -> bool:
    return is_broad_ or not seed_scores or max(seed_scores) < ENOUGH


def corrective_queries(question: Column, concepts: Column, aspects: Column, given: Column) -> Column:
    """The question, concepts, aspects and the first terms together; distinct, in byte order, at most 36."""
    joined = F.when(F.size(given) > 1, F.array(F.array_join(F.slice(given, 1, 8), " "))).otherwise(F.array().cast("array<string>"))
    return F.slice(normalized(F.concat(F.array(trim(question)), F.slice(concepts, 1, 30), F.slice(aspects, 1, 12), joined)), 1, CORRECTIVE_QUERIES)


def merge_in_order(hits: DataFrame, step: float = CORRECTIVE_STEP) -> DataFrame:
    """(key..., chunk_id, document_id, score) from (run_id, chunk_id, document_id, seq, score): in the order of seq, a chunk that comes again has the larger score plus step.

    A chunk's scores are few, one for each query, so the fold is over a small array.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "score")))
    rows = hits.groupBy("run_id", "chunk_id", "document_id").agg(ordered.alias("parts"))
    first = F.element_at("parts", 1).getField("score")
    total = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), first, lambda acc, x: F.greatest(acc, x.getField("score")) + step)
    return rows.select("run_id", "chunk_id", "document_id", F.round(total, DIGITS).alias("score"))


def corrective_merge(hits: DataFrame, limit: int = CORRECTIVE_HITS) -> DataFrame:
    """Seed hits (seq -1) and those of all queries, merged and diversified: (run_id, chunk_id, document_id, score, rank)."""
    return diversify(merge_in_order(hits), limit, keys=("run_id",))


def _diversified(hits: list[list], limit: int) -> list[list]:
    """Of (minus score, chunk, document): the best after repeats of a document are lowered, in order."""
    hits.sort()
    seen: dict[int, int] = {}
    lowered = False
    for h in hits:
        n = seen.get(h[2], 0)
        if n >= PER_DOCUMENT:
            h[0] = round(h[0] * REPEAT_FACTOR, DIGITS)
            lowered = True
        seen[h[2]] = n + 1
    if lowered:
        hits.sort()
    return hits[:limit]


class _Fold:
    """The merged hits of one run, given its rows in the order of seq, chunk, document and score."""

    def __init__(self, run: str | None, limit: int, step: float):
        self.run, self.limit, self.step = run, limit, step
        self.seq: int | None = None
        self.merged: dict[int, list] = {}  # by chunk: [minus score, chunk, document]
        self.started = False

    def add(self, seq: int, chunk: int, doc: int, score: float) -> None:
        if self.started and seq != self.seq:
            self._close()
        self.seq, self.started = seq, True
        if (h := self.merged.get(chunk)) is not None:
            h[0] = -round(max(-h[0], score) + self.step, DIGITS)
        else:
            self.merged[chunk] = [-score, chunk, doc]

    def _close(self) -> None:
        kept = _diversified(list(self.merged.values()), self.limit)
        self.merged = {h[1]: h for h in kept}

    def rows(self) -> pa.RecordBatch:
        self._close()
        out = list(self.merged.values())
        return pa.RecordBatch.from_pydict({"run_id": pa.array([self.run] * len(out), pa.string()), "chunk_id": pa.array([h[1] for h in out], pa.int64()), "document_id": pa.array([h[2] for h in out], pa.int64()), "score": pa.array([0.0 - h[0] for h in out], pa.float64()), "rank": pa.array(range(1, len(out) + 1), pa.int32())})


def guided_merge(hits: DataFrame, limit: int = GUIDED_HITS, step: float = GUIDED_STEP) -> DataFrame:
    """Merges (run_id, seq, chunk_id, document_id, score) query by query, diversified after each.

    Penalties compound from merge to merge, so the fold can't be reordered; but it holds no more than
    limit hits and those of one query. Spark sorts the rows of each run, which pass through it once.
    """

    columns = ["run_id", "seq", "chunk_id", "document_id", "score"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            values = [c.to_pylist() if c.null_count or c.type == pa.string() else c.to_numpy().tolist() for c in map(batch.column, columns)]
            for run, seq, chunk, doc, score in zip(*values, strict=True):
                if now is None or run != now.run:
                    if now is not None:
                        yield now.rows()
                    now = _Fold(run, limit, step)
                now.add(seq, chunk, doc, score)
        if now is not None:
            yield now.rows()

    ordered = hits.select(*columns).repartition("run_id").sortWithinPartitions(*columns)
    return ordered.mapInArrow(fold, "run_id string, chunk_id long, document_id long, score double, rank int")


def focused_chunks(chunks: DataFrame, hits: DataFrame, cap: int = FOCUS_CHUNKS) -> DataFrame:
    """Each hit's chunk, its neighbours and the first chunks under its heading; the first by id."""
    hit = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    near = hit.select(F.explode(F.array("prev_chunk_id", "chunk_id", "next_chunk_id")).alias("chunk_id")).where("chunk_id IS NOT NULL")
    headings = hit.where("heading_path <> ''").select("document_id", "heading_path").distinct()
    nth = F.row_number().over(W.partitionBy("document_id", "heading_path").orderBy("ordinal"))
    mates = chunks.join(headings, ["document_id", "heading_path"], "left_semi").withColumn("nth", nth).where(F.col("nth") <= FOCUS_SIBLINGS).select("chunk_id")
    return chunks.join(near.unionByName(mates).distinct(), "chunk_id", "left_semi").orderBy("chunk_id").limit(cap)


def source_concepts(chunks: DataFrame, reqs: DataFrame) -> DataFrame:
    """(query_id, concepts): concepts of headings and texts, scored against each request (query_id, query, terms), the best 80 of a broad one or 30, in byte order.

    Requests are parameters; concepts are counted by chunk before they meet them.
    """
    heads = chunks.select("chunk_id", "heading_path", "content", F.explode(heading_concepts("heading_path")).alias("concept"))
    heads = heads.select("concept", (F.lit(1.0) + F.when(F.contains(F.col("content"), F.col("concept")), 0.5).otherwise(0.0)).alias("base"))
    found = chunks.select("chunk_id", "heading_path", F.explode(content_concepts("content")).alias("concept")).groupBy("chunk_id", "heading_path", "concept").agg(F.count("*").alias("n"))
    found = found.select("concept", (F.least(F.col("n"), F.lit(8)) * 0.75 + F.when(F.contains(F.col("heading_path"), F.col("concept")), 2.0).otherwise(0.0)).alias("base"))
    sums = heads.unionByName(found).where(~F.col("concept").isin(GENERIC)).groupBy("concept").agg(F.sum("base").alias("base"), F.count("*").alias("times"))
    rows = sums.crossJoin(F.broadcast(reqs.select("query_id", "query", "terms", meaningful_terms("query", F.col("terms")).alias("wanted"), is_broad("query", F.col("terms")).alias("broad"))))
    rows = rows.withColumn("match", matches_any(F.col("concept"), F.col("wanted"))).withColumn("score", F.col("base") + F.when(F.col("match"), F.col("times") * 8.0).otherwise(0.0))
    kept = rows.where(F.col("broad") | (F.col("score") >= 8.0) | F.col("match"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "concept"))
    best = kept.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("broad"), 80).otherwise(30))
    return best.groupBy("query_id").agg(normalized(F.collect_list("concept")).alias("concepts"))


def followup_queries(facts: DataFrame, known: Column, cap: int = GUIDED_QUERIES) -> DataFrame:
    """(query): from the first 120 facts (seq), terms that aren't known yet, and objects with the start of their condition or effect; in byte order."""
    head = facts.orderBy("seq").limit(120)
    fields = F.flatten(F.array(*(terms(c) for c in ("object", "subject", "condition", "effect", "exception"))))
    new = F.filter(fields, lambda t: (F.length(t) >= 2) & ~is_stop(t) & ~F.array_contains(known, t))
    pair = lambda c: F.when((F.length(trim("object")) > 0) & (F.length(trim(c)) > 0), F.concat(trim("object"), F.lit(" "), first_chars(trim(c), 40)))
    every = F.concat(new, F.array_compact(F.array(pair("condition"), pair("effect"))))
    return head.select(F.explode(normalized(every)).alias("query")).distinct().orderBy("query").limit(cap)

"""Context for prompts: relevant sections, bins of chunks, texts within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import normalized

# Fixed values
CONTEXT_CHARS, BATCH_CHARS, CHUNK_OVERHEAD = 12_000, 6_000, 80
CORPUS_CONCEPTS = 120
NOTHING = "階層文脈なし"


def relevant_sections(sections: DataFrame, wanted: Column, hits: Column, broad: bool) -> DataFrame:
    """Sections with a score and rank: 8 for a hit, 4 for a term in the heading, 4 for a concept that meets a term, 1 if broad; the best 120 or 60."""
    meets = F.exists("concepts", lambda c: F.exists(wanted, lambda t: F.contains(c, t) | F.contains(t, c)))
    score = (
        F.when(F.arrays_overlap("chunk_ids", hits), 8.0).otherwise(0.0)
        + F.when(F.exists(wanted, lambda t: F.contains(F.col("heading_path"), t)), 4.0).otherwise(0.0)
        + F.when(meets, 4.0).otherwise(0.0)
        + float(broad)
    )
    rows = sections.withColumn("score", F.round(score, 1)).orderBy(F.desc("score"), "file_name", "char_start", "document_id", "heading_path").limit(120 if broad else 60)
    # at most 120 rows are left to number
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "file_name", "char_start", "document_id", "heading_path")))


def corpus_concepts(lower: Column, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: a request's concepts, the first 30 of each document and the first 12 of each kept section; the first 120 in byte order."""
    parts = documents.select(F.explode(F.slice("concepts", 1, 30)).alias("c")).unionByName(sections.select(F.explode(F.slice("concepts", 1, 12)).alias("c"))).distinct()
    best = parts.where(F.length("c").between(2, 80)).orderBy("c").limit(CORPUS_CONCEPTS)
    return best.agg(F.collect_list("c").alias("found")).select(F.slice(normalized(F.concat(lower, "found")), 1, CORPUS_CONCEPTS).alias("concepts"))


def cost(chunks: DataFrame) -> Column:
    return F.length("content") + F.length("heading_path") + CHUNK_OVERHEAD


def bins(chunks: DataFrame, keys: list[str], order: list[str], budget: int = BATCH_CHARS) -> DataFrame:
    """(keys, chunk_id, bin): greedy bins in order; a chunk over the budget has its own.

    The fold isn't associative. It runs over the costs of one group of keys, ids and numbers only.
    """
    rows = chunks.select(*keys, "chunk_id", F.struct(*order, F.col("chunk_id").alias("_id"), cost(chunks).alias("_cost")).alias("_row"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def put(acc: Column, row: Column) -> Column:
        c = row.getField("_cost")
        new = (acc.getField("bin") < 0) | (acc.getField("used") + c > budget)
        bin_ = acc.getField("bin") + new.cast("int")
        return F.struct(bin_.alias("bin"), F.when(new, c).otherwise(acc.getField("used") + c).alias("used"), F.concat(acc.getField("out"), F.array(bin_)).alias("out"))

    filled = listed.withColumn("out", F.aggregate("rows", start, put).getField("out"))
    return filled.select(*keys, F.inline(F.arrays_zip(F.col("rows").getField("_id").alias("chunk_id"), F.col("out").alias("bin")))).toDF(*keys, "chunk_id", "bin")


def hit_block() -> Column:
    return F.format_string("[S%d] file=%s chunk=%d chars=%d-%d heading=%s\n%s\n\n", "rank", "file_name", "chunk_id", "char_start", "char_end", "heading_path", "snippet")


def within_budget(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Hits of each query (query_id, rank, ...) up to the first whose block would pass the budget, with block and used."""
    w = W.partitionBy("query_id").orderBy("rank")
    rows = hits.withColumn("block", hit_block())
    return rows.withColumn("used", F.sum(F.length("block")).over(w)).where(F.col("used") <= budget)


def context_text(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context)."""
    parts = within_budget(hits, budget).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("parts"))
    return parts.select("query_id", F.array_join(F.col("parts").getField("block"), "").alias("context"))


def _joined(items: Column, n: int, by: str = ", ") -> Column:
    return F.array_join(F.slice(items, 1, n), by)


def hierarchy(documents: DataFrame, contexts: DataFrame, sections: DataFrame, chosen: DataFrame, wanted: Column, hits: Column, broad: bool) -> tuple[DataFrame, DataFrame]:
    """What the chosen documents (document_id) lie in: (documents, sections) with file_name and path, of sections the relevant ones with their rank."""
    named = documents.select(F.col("id").alias("document_id"), "file_name", "path").join(chosen.distinct(), "document_id", "left_semi")
    return contexts.join(named, "document_id"), relevant_sections(sections.join(named, "document_id"), wanted, hits, broad)


def batch_contexts(batches: DataFrame, documents: DataFrame, sections: DataFrame, concepts: list[str]) -> DataFrame:
    """(batch_id, context): what each batch of chunks (batch_id, document_id, chunk_id, heading_path) lies in.

    At most 60 concepts, 8 documents and 12 sections that share a chunk or heading with it. documents
    and sections are as hierarchy gives them; of sections there are at most 120, so they are broadcast.
    """
    doc_line = F.format_string("- file=%s path=%s chunks=%d chars=%d concepts=%s summary=%s", "file_name", "path", "chunk_count", "char_count", _joined(F.col("concepts"), 20), "summary_text")
    sec_line = F.format_string("- file=%s path=%s heading=%s chars=%d-%d concepts=%s summary=%s", "file_name", "path", "heading_path", "char_start", "char_end", _joined(F.col("concepts"), 20), "summary_text")
    listed = lambda n: F.array_join(F.slice(F.array_sort(F.collect_set("line")), 1, n).getField("text"), "\n")
    docs = documents.select("document_id", F.struct("file_name", "document_id", doc_line.alias("text")).alias("line"))
    docs = batches.select("batch_id", "document_id").distinct().join(docs, "document_id").groupBy("batch_id").agg(listed(8).alias("docs"))
    secs = F.broadcast(sections.select("document_id", "chunk_ids", F.col("heading_path").alias("_h"), F.struct("rank", sec_line.alias("text")).alias("line")))
    mine = batches.join(secs, "document_id").where(F.array_contains("chunk_ids", F.col("chunk_id")) | (F.col("heading_path") == F.col("_h")))
    mine = mine.groupBy("batch_id").agg(listed(12).alias("secs"))
    head = f"CORPUS concepts: {', '.join(concepts[:60])}\n" if concepts else ""
    rows = batches.select("batch_id").distinct().join(docs, "batch_id", "left").join(mine, "batch_id", "left")
    text = F.concat(F.lit(head + "DOCUMENT parents:\n"), F.coalesce("docs", F.lit("")), F.lit("\nSECTION parents:\n"), F.coalesce("secs", F.lit("")), F.lit("\n"))
    return rows.select("batch_id", F.when(F.col("docs").isNull() & F.col("secs").isNull(), NOTHING).otherwise(text).alias("context"))


def answer_context(documents: DataFrame, sections: DataFrame, concepts: list[str], broad: bool) -> str:
    """The same for the answer: 80 concepts, 20 documents and, for a broad question, 60 sections."""
    if documents.isEmpty() and sections.isEmpty():
        return NOTHING
    doc_line = F.format_string("- file=%s path=%s chunks=%d chars=%d concepts=%s headings=%s summary=%s", "file_name", "path", "chunk_count", "char_count", _joined(F.col("concepts"), 20), _joined(F.col("heading_index"), 12, " / "), "summary_text")
    out = [f"CORPUS concepts: {', '.join(concepts[:80])}", "DOCUMENT summaries:"]
    out += [r[0] for r in documents.orderBy("file_name", "document_id").limit(20).select(doc_line).collect()]
    if broad:
        sec_line = F.format_string("- file=%s path=%s heading=%s concepts=%s summary=%s", "file_name", "path", "heading_path", _joined(F.col("concepts"), 16), "summary_text")
        out += ["RELEVANT section summaries:", *(r[0] for r in sections.orderBy("rank").limit(60).select(sec_line).collect())]
    return "\n".join(out) + "\n"

"""Registered queries of the retrieval engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import concepts
from tessella.functions import text as tx
from tessella.operators import catalog, chats, chunking, context, evaluate, expand, facts, index, search
from tessella.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL twin if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _search(spark: SparkSession, sf_dir: str):
    return search.requests(spark, fx.QUESTIONS), search.Index.over(fx.chunks(spark, sf_dir)), fx.selected(spark, sf_dir)


@query(f"{fx.BASE},\n{fx.FTS} SELECT query_id, chunk_id, bm25, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fts")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fts(*_search(spark, sf_dir)).select("query_id", "chunk_id", "bm25", F.round("score", 6).alias("score"), "rank")


@query(f"{fx.BASE},\n{fx.TERMS},\n{fx.NGRAM} SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM ngram")
def ngram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ngram(*_search(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query(f"{fx.BASE},\n{fx.VECTOR} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM vector")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector(*_search(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


_RANKERS = f"{fx.BASE},\n{fx.FTS},\n{fx.TERMS},\n{fx.NGRAM},\n{fx.VECTOR},\n{fx.FUSE}"


@query(f"{_RANKERS} SELECT query_id, chunk_id, round(rrf, 9) AS rrf, round(fts_score, 6) AS fts_score, CAST(ngram_score AS DOUBLE) AS ngram_score, vector_score FROM fuse")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = search.fuse(search.rankings(*_search(spark, sf_dir)))
    return fused.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.round("fts_score", 6).alias("fts_score"), "ngram_score", "vector_score")


@query(
    f"{_RANKERS},\n{fx.hybrid_sql(12)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, document_id, file_name, heading_path, char_start, char_end, round(score, 6) AS score, round(exact_bonus, 6) AS exact_bonus, round(heading_bonus, 6) AS heading_bonus FROM hits"
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three requests over all selected documents."""
    hits = search.hybrid_search(*_search(spark, sf_dir), limit=12)
    return hits.select("query_id", "rank", "chunk_id", "document_id", "file_name", "heading_path", "char_start", "char_end", *(F.round(c, 6).alias(c) for c in ("score", "exact_bonus", "heading_bonus")))


# --- catalogue -----------------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir).drop("text", "heading").withColumn("error", F.lit(None).cast("string"))


@query(f"WITH {fx.CHUNKS} SELECT id, path, file_name, docs.size AS size, char_count, sha256, selected, status, CAST(coalesce(n, 0) AS BIGINT) AS chunk_count FROM docs LEFT JOIN (SELECT document_id, count(*) AS n FROM ch GROUP BY 1) c ON c.document_id = docs.id")
def doc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_chunk_counts(_docs(spark, sf_dir), fx.chunks(spark, sf_dir)).select("id", "path", "file_name", "size", "char_count", "sha256", "selected", "status", "chunk_count")


@query(
    f"WITH {fx.CHUNKS}, n AS (SELECT document_id, count(*) AS n FROM ch GROUP BY 1) SELECT count(*) AS document_count, count(*) FILTER (WHERE selected) AS selected_document_count, CAST(coalesce(sum(char_count), 0) AS BIGINT) AS total_chars, CAST(coalesce(sum(char_count) FILTER (WHERE selected), 0) AS BIGINT) AS selected_chars, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunk_count, CAST(coalesce(sum(n) FILTER (WHERE selected), 0) AS BIGINT) AS selected_chunk_count FROM docs LEFT JOIN n ON n.document_id = docs.id"
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stats(_docs(spark, sf_dir), fx.chunks(spark, sf_dir))


def _rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan of the corpus: files of src3 are gone, those of src1 are newer, those of src2 have other content."""
    d = _docs(spark, sf_dir)
    source = F.split("path", "/")[2]
    return d.where(source != "src3").withColumn("mtime_ms", F.col("mtime_ms") + (source == "src1").cast("int")).withColumn("sha256", F.when(source == "src2", F.sha2("sha256", 256)).otherwise(F.col("sha256")))


_RESCAN = "scan AS (SELECT id, path, file_name, size, mtime_ms + CASE WHEN split_part(path, '/', 3) = 'src1' THEN 1 ELSE 0 END AS mtime_ms, CASE WHEN split_part(path, '/', 3) = 'src2' THEN sha256(sha256) ELSE sha256 END AS sha256, char_count FROM docs WHERE split_part(path, '/', 3) <> 'src3')"


@query(f"WITH {fx.DOCS}, {_RESCAN} SELECT s.path, s.size, s.mtime_ms, s.sha256 FROM scan s JOIN docs d ON d.path = s.path WHERE d.mtime_ms <> s.mtime_ms OR d.sha256 <> s.sha256 OR d.size <> s.size")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.changed(_rescan(spark, sf_dir), _docs(spark, sf_dir), fx.chunks(spark, sf_dir)).select("path", "size", "mtime_ms", "sha256")


@query(f"WITH {fx.DOCS}, {_RESCAN} SELECT id, path, CASE WHEN path IN (SELECT path FROM scan) THEN 'indexed' ELSE 'missing' END AS status FROM docs")
def mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.mark_missing(_docs(spark, sf_dir), _rescan(spark, sf_dir)).select("id", "path", "status")


@query(
    f"""WITH {fx.DOCS}, known AS (SELECT * FROM docs WHERE split_part(path, '/', 3) <> 'src5'), top AS (SELECT max(id) AS top FROM known)
SELECT coalesce(k.id, top + row_number() OVER (PARTITION BY k.id IS NULL ORDER BY d.path)) AS id, d.path, d.sha256, coalesce(k.selected, true) AS selected FROM docs d LEFT JOIN known k ON k.path = d.path CROSS JOIN top"""
)
def upsert_keep_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue that lacks src5 meets a scan of everything."""
    d = _docs(spark, sf_dir)
    return catalog.upsert(d.where(F.split("path", "/")[2] != "src5"), d).select("id", "path", "sha256", "selected")


@query(f"WITH {fx.DOCS} SELECT id AS document_id FROM docs WHERE selected AND status = 'indexed'")
def selection_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve_selection(_docs(spark, sf_dir))


@query(f"WITH {fx.DOCS} SELECT id, path FROM docs WHERE status = 'indexed' AND id NOT IN (SELECT doc_id FROM labels)")
def backfill_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.needs_backfill(_docs(spark, sf_dir), fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))).select("id", "path")


@query("SELECT user_id AS run_id, min(ts) AS started_at, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY 1")
def run_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return catalog.latest_runs(e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


@query("SELECT conv_id, turn, item_id FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1, item_id, ' ' || text || chr(10) FROM benchmark) q LEFT JOIN benchmark b ON b.text = trim(q.text, ' ' || chr(10) || chr(9) || chr(13)) AND b.item_id % 2 = 0")
def eval_item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of conversations, and the benchmark's with blanks around them, against an evaluation set of which every second item is active."""
    b, c = fx.table(spark, sf_dir, "benchmark"), fx.table(spark, sf_dir, "conversations")
    items = b.select(F.col("item_id").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 2 == 0).alias("active"))
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    asked = asked.unionByName(b.select(F.lit(-1).cast("long").alias("conv_id"), F.col("item_id").alias("turn"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("question")))
    return catalog.find_items(items, asked).select("conv_id", "turn", "item_id")


# --- text functions ------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_terms, sha256(array_to_string(list_sort(t), ' ')) AS terms_sha256 FROM (SELECT doc_id, {fx.terms_sql('text')} AS t FROM documents)")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").withColumn("t", tx.terms("text"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.sha2(F.array_join("t", " "), 256).alias("terms_sha256"))


@query(f"SELECT doc_id, CAST(coalesce(list_sum(list_transform(t, lambda x: CASE WHEN length(x) >= 4 THEN 2.0 ELSE 1.0 END)), 0) AS DOUBLE) AS weight FROM (SELECT doc_id, {fx.terms_sql('text')} AS t FROM documents)")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.transform(tx.terms("text", ordered=False), tx.term_weight)
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.aggregate(weights, F.lit(0.0), lambda a, x: a + x).alias("weight"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.,]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) BETWEEN 2 AND 80))), '|') AS items FROM documents")
def normalize_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of each document as a normalised list."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.normalized(F.split("text", "[.,]")), "|").alias("items"))


@query(f"SELECT conv_id, turn, (length(q) <= 12 AND len(t) <= 8) OR {' OR '.join(f'''contains(q, '{m}')''' for m in tx.BROAD_MARKERS)} AS broad FROM (SELECT conv_id, turn, trim(text) AS q, {fx.terms_sql('text')} AS t FROM conversations)")
def broad_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_broad("text", tx.terms("text")).alias("broad"))


@query(f"{fx.BASE} SELECT query_id, chunk_id, round(CAST({fx.bonus_sql('content')} AS DOUBLE), 6) AS bonus FROM ch CROSS JOIN req")
def exact_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = search.requests(spark, fx.QUESTIONS)
    return fx.chunks(spark, sf_dir).crossJoin(F.broadcast(reqs)).select("query_id", "chunk_id", F.round(tx.exact_bonus("query", "terms", "content"), 6).alias("bonus"))


@query(
    f"""{fx.BASE.replace(fx.CHUNKS, fx.DOCS)}, p AS (SELECT query_id, id, text, coalesce(list_filter(list_transform(terms, lambda t: instr(text, t)), lambda p: p > 0)[1], 1) - 1 AS hit FROM docs CROSS JOIN req), s AS (SELECT *, greatest(hit - 233, 0) AS a, least(greatest(hit - 233, 0) + 700, length(text)) AS b FROM p)
SELECT query_id, id, sha256(CASE WHEN length(text) <= 700 THEN text ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || substring(text, a + 1, b - a) || CASE WHEN b < length(text) THEN '...' ELSE '' END END) AS snippet_sha256 FROM s"""
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = search.requests(spark, fx.QUESTIONS)
    return fx.documents(spark, sf_dir).crossJoin(F.broadcast(reqs)).select("query_id", "id", F.sha2(tx.snippet("text", "terms"), 256).alias("snippet_sha256"))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@query("SELECT doc_id, replace(substring(text, 1, 260) || CASE WHEN length(text) > 260 THEN '...' ELSE '' END, chr(10), ' ') AS head, substring(text, 1, 120) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END AS logged FROM documents")
def first_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.first_chars("text", 260).alias("head"), tx.truncated("text", 120).alias("logged"))


# --- chunks and indexes --------------------------------------------------------------------------

# Texts without headings are one section; it is trimmed, and split at line ends if over 2400 characters.
_LONG = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, len(t) AS total, unnest(regexp_extract_all(t, '[^\n]*\n|[^\n]+')) AS line, unnest(range(1, len(regexp_extract_all(t, '[^\n]*\n|[^\n]+')) + 1)) AS i FROM d),
f AS (SELECT doc_id, i, line, total, 0 AS chunk, length(line) AS held, CAST(0 AS BIGINT) AS start, CAST(length(line) AS BIGINT) AS cursor FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.line, l.total, CASE WHEN l.total > 2400 AND f.held + length(l.line) > 2400 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN l.total > 2400 AND f.held + length(l.line) > 2400 THEN length(l.line) ELSE f.held + length(l.line) END,
    CASE WHEN l.total > 2400 AND f.held + length(l.line) > 2400 THEN f.cursor ELSE f.start END, f.cursor + length(l.line) FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
c AS (SELECT doc_id, chunk, min(start) AS char_start, string_agg(line, '' ORDER BY i) AS raw FROM f GROUP BY 1, 2)
SELECT c.doc_id AS document_id, CAST(chunk AS BIGINT) AS ordinal, char_start, CASE WHEN length(t) > 2400 THEN char_start + length(raw) ELSE length(text) END AS char_end, sha256(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS content_hash FROM c JOIN d USING (doc_id) JOIN documents USING (doc_id)"""


@query(_LONG)
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through the chunker: they have no headings, so long ones are split at line ends."""
    d = fx.documents(spark, sf_dir).select(F.col("id").alias("document_id"), "path", "text").repartition(spark.sparkContext.defaultParallelism)
    return chunking.chunk_documents(d).select("document_id", "ordinal", "char_start", "char_end", "content_hash")


@query(f"WITH {fx.CHUNKS} SELECT chunk_id, document_id, ordinal, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM ch WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.chunks(spark, sf_dir).select("chunk_id", "document_id", "ordinal", "prev_chunk_id", "next_chunk_id")


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown with a heading each; tests compare with a golden text."""
    p = fx.table(spark, sf_dir, "pages")
    text = F.concat(F.lit("# "), "url", F.lit("\n"), F.regexp_replace("html", "<h1>", "\n## "), F.lit("\n第1章 総則\n（目的）\n第2条 この規程は\n"))
    return chunking.chunk_documents(p.select(F.col("page_id").alias("document_id"), F.concat("url", F.lit(".md")).alias("path"), text.alias("text"))).select("chunk_id", "document_id", "ordinal", "heading_path", "char_start", "char_end", "content_hash")


@query(f"WITH {fx.CHUNKS},\n{fx.TERMS} SELECT term, chunk_id, CAST(weight AS DOUBLE) AS weight FROM te")
def ngram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_index(fx.chunks(spark, sf_dir))


@query(f"WITH {fx.CHUNKS},\n{fx.hash_sql('ve', 'ch', 'chunk_id', 'heading_path || chr(10) || content')} SELECT chunk_id, dim, round(CAST(value AS DOUBLE), 5) AS value FROM ve")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = index.hash_vectors(fx.chunks(spark, sf_dir), "chunk_id", F.concat("heading_path", F.lit("\n"), "content"))
    return v.select("chunk_id", "dim", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(f"WITH {fx.CHUNKS} SELECT chunk_id, len({fx.tokens_sql('content')}) + len({fx.tokens_sql('heading_path')}) + len({fx.tokens_sql('file_name')}) AS size FROM ch")
def fts_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lengths(fx.chunks(spark, sf_dir)).select("chunk_id", F.col("size").cast("long").alias("size"))


_SECTIONS = f"""WITH {fx.CHUNKS}, sec AS (SELECT document_id, heading_path, min(char_start) AS char_start, max(char_end) AS char_end, list(chunk_id ORDER BY ordinal) AS ids, arg_min(content, ordinal) AS first FROM ch GROUP BY 1, 2),
con AS (SELECT document_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(heading_path, ' > '), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 50))), ', ') AS concepts FROM (SELECT DISTINCT document_id, heading_path FROM ch))"""


@query(
    f"{_SECTIONS} SELECT document_id, heading_path, char_start, char_end, array_to_string(ids, ',') AS chunk_ids, concepts, 'section=' || heading_path || ' chars=' || char_start || '-' || char_end || ' chunks=' || len(ids) || ' concepts=' || concepts || ' sample=' || replace(substring(first, 1, 260) || CASE WHEN length(first) > 260 THEN '...' ELSE '' END, chr(10), ' ') AS summary_text FROM sec JOIN con USING (document_id)"
)
def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = index.section_rollup(fx.chunks(spark, sf_dir))
    return r.select("document_id", "heading_path", "char_start", "char_end", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"), F.array_join("concepts", ", ").alias("concepts"), "summary_text")


@query(f"{_SECTIONS} SELECT sec.document_id, len(ids) AS chunk_count, char_count, concepts, heading_path AS heading_index, 'document=' || file_name || ' chars=' || char_count || ' chunks=' || len(ids) || ' concepts=' || concepts || ' headings=' || heading_path AS summary_text FROM sec JOIN con USING (document_id) JOIN docs ON docs.id = sec.document_id")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = index.document_rollup(fx.documents(spark, sf_dir), fx.chunks(spark, sf_dir))
    return r.select("document_id", "chunk_count", "char_count", F.array_join("concepts", ", ").alias("concepts"), F.array_join("heading_index", " / ").alias("heading_index"), "summary_text")


@query(
    f"WITH {fx.CHUNKS}, s AS (SELECT split_part(heading_path, ' > ', 2) AS source, unnest(list_filter(string_split(heading_path, ' > '), lambda x: length(x) >= 2)) AS concept FROM ch), g AS (SELECT source, concept, count(*) * 3.0 AS score FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, concept) <= 3) SELECT source, string_agg(concept, ', ' ORDER BY concept) AS concepts FROM g GROUP BY 1"
)
def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir).withColumn("source", F.split("heading_path", " > ")[1])
    return concepts.top_concepts(c, ["source"], 3).select("source", F.array_join("concepts", ", ").alias("concepts"))


# --- from candidates to hits ---------------------------------------------------------------------


@query(f"{_RANKERS},\n{fx.scored_sql('s1', 'fuse')} SELECT query_id, chunk_id, round(score, 6) AS score, round(exact_bonus, 6) AS exact_bonus, round(heading_bonus, 6) AS heading_bonus FROM s1")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs, ix, docs = _search(spark, sf_dir)
    s = search._scored(search.fuse(search.rankings(reqs, ix, docs)), reqs, ix)
    return s.select("query_id", "chunk_id", *(F.round(c, 6).alias(c) for c in ("score", "exact_bonus", "heading_bonus")))


@query(f"{_RANKERS},\n{fx.hybrid_sql(12)} SELECT query_id, chunk_id, round(rrf, 9) AS rrf FROM cand")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs, ix, docs = _search(spark, sf_dir)
    fused = search.fuse(search.rankings(reqs, ix, docs))
    return search.with_neighbours(fused, reqs, ix, 12).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"))


_HITS = "hit AS (SELECT CAST(user_id % 7 AS VARCHAR) AS query_id, event_id AS chunk_id, user_id AS document_id, round(abs(value) / 100.0, 6) AS score FROM events)"


def _event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 7).cast("string").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("user_id").alias("document_id"), F.round(F.abs("value") / 100.0, 6).alias("score"))


@query(
    f"WITH {_HITS}, low AS (SELECT * EXCLUDE (score), round(CASE WHEN row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) > 3 THEN score * 0.86 ELSE score END, 9) AS score FROM hit) SELECT query_id, chunk_id, document_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM low QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40"
)
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits of their users' documents."""
    return search.diversify(_event_hits(spark, sf_dir), 40).withColumn("score", F.round("score", 6)).select("query_id", "chunk_id", "document_id", "score", "rank")


_MERGED = "mh AS (SELECT CAST(user_id % 7 AS VARCHAR) AS run_id, user_id % 60 AS chunk_id, user_id % 20 AS document_id, event_id AS seq, round(abs(value) / 100.0, 6) AS score FROM events)"


def _run_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 7).cast("string").alias("run_id"), (F.col("user_id") % 60).alias("chunk_id"), (F.col("user_id") % 20).alias("document_id"), F.col("event_id").alias("seq"), F.round(F.abs("value") / 100.0, 6).alias("score"))


# max(a, b) + step in order equals the largest of each score plus step for every later one, and the first without.
@query(
    f"""WITH {_MERGED}, n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY run_id, chunk_id, document_id) AS n FROM mh WINDOW w AS (PARTITION BY run_id, chunk_id, document_id ORDER BY seq, score)),
m AS (SELECT run_id, chunk_id, document_id, round(max(score + 0.015 * (n - greatest(k, 2) + 1)) FILTER (WHERE n > 1 OR k = 1), 9) AS s, max(score) AS only_, max(n) AS n FROM n GROUP BY 1, 2, 3),
h AS (SELECT run_id, chunk_id, document_id, CASE WHEN n = 1 THEN only_ ELSE s END AS score FROM m),
low AS (SELECT * EXCLUDE (score), round(CASE WHEN row_number() OVER (PARTITION BY run_id, document_id ORDER BY score DESC, chunk_id) > 3 THEN score * 0.86 ELSE score END, 9) AS score FROM h)
SELECT run_id, chunk_id, document_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM low QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, chunk_id) <= 32"""
)
def corrective_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.corrective_merge(_run_hits(spark, sf_dir)).withColumn("score", F.round("score", 6)).select("run_id", "chunk_id", "document_id", "score", "rank")


@query()
def guided_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hits a query; penalties compound, so there is no SQL form. Tests compare with a plain fold."""
    hits = _run_hits(spark, sf_dir).withColumn("seq", F.floor(F.col("seq") / 40))
    hits = hits.groupBy("run_id", "seq", "chunk_id", "document_id").agg(F.max("score").alias("score"))
    return expand.guided_merge(hits).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {fx.CHUNKS}, c AS (SELECT *, lag(chunk_id) OVER w AS p, lead(chunk_id) OVER w AS n, row_number() OVER (PARTITION BY document_id, heading_path ORDER BY ordinal) AS nth FROM ch WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)), hit AS (SELECT * FROM c WHERE contains(content, 'tion that')),
ids AS (SELECT p AS id FROM hit UNION SELECT chunk_id FROM hit UNION SELECT n FROM hit UNION SELECT c.chunk_id FROM c JOIN (SELECT DISTINCT document_id, heading_path FROM hit) h USING (document_id, heading_path) WHERE nth <= 4) SELECT chunk_id, document_id FROM c WHERE chunk_id IN (SELECT id FROM ids) ORDER BY chunk_id LIMIT 96"""
)
def focused_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    return expand.focused_chunks(c, c.where(F.contains("content", F.lit("tion that")))).select("chunk_id", "document_id")


@query(
    f"""{fx.BASE}, s AS (SELECT query_id, concept, count(*) + 0.5 * count(*) FILTER (WHERE contains(content, concept)) AS base, count(*) AS n, query, terms FROM (SELECT chunk_id, content, unnest(list_distinct(list_filter(string_split(heading_path, ' > '), lambda x: length(x) >= 2))) AS concept FROM ch) CROSS JOIN req GROUP BY query_id, concept, query, terms),
m AS (SELECT *, len(list_filter(terms, lambda t: contains(concept, t) OR contains(t, concept))) > 0 AS hit FROM s), r AS (SELECT query_id, concept, base + CASE WHEN hit THEN 8 * n ELSE 0 END AS score, hit FROM m), k AS (SELECT * FROM r WHERE score >= 8 OR hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept) <= 30)
SELECT query_id, string_agg(concept, ', ' ORDER BY concept) AS concepts FROM k GROUP BY 1"""
)
def source_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = expand.source_concepts(fx.chunks(spark, sf_dir), search.requests(spark, fx.QUESTIONS))
    return r.select("query_id", F.array_join("concepts", ", ").alias("concepts"))


# --- context -------------------------------------------------------------------------------------


@query(
    f"""{_SECTIONS}, r AS (SELECT sec.document_id, heading_path, file_name, char_start, CASE WHEN len(list_filter(ids, lambda x: x % 1000000 = 2)) > 0 THEN 8.0 ELSE 0.0 END + CASE WHEN contains(heading_path, 'src3') OR contains(heading_path, 'en') THEN 8.0 ELSE 0.0 END AS score FROM sec JOIN docs ON docs.id = sec.document_id)
SELECT document_id, heading_path, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER w AS INTEGER) AS rank FROM r WINDOW w AS (ORDER BY score DESC, file_name, char_start, document_id, heading_path) QUALIFY row_number() OVER w <= 60"""
)
def section_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's third chunk as a hit, and two terms."""
    c = fx.chunks(spark, sf_dir)
    sections = index.section_rollup(c).join(fx.documents(spark, sf_dir).select(F.col("id").alias("document_id"), "file_name", "path"), "document_id")
    sections = sections.withColumn("hits", F.filter("chunk_ids", lambda x: x % 1_000_000 == 2))
    return context.relevant_sections(sections, F.array(F.lit("src3"), F.lit("en")), F.col("hits"), False).select("document_id", "heading_path", "score", "rank")


@query(
    f"""WITH RECURSIVE {fx.CHUNKS}, n AS (SELECT document_id, chunk_id, length(content) + length(heading_path) + 80 AS cost, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS i FROM ch),
f AS (SELECT document_id, chunk_id, i, cost AS used, 0 AS bin FROM n WHERE i = 1 UNION ALL SELECT n.document_id, n.chunk_id, n.i, CASE WHEN f.used + n.cost > 6000 THEN n.cost ELSE f.used + n.cost END, CASE WHEN f.used + n.cost > 6000 THEN f.bin + 1 ELSE f.bin END FROM f JOIN n ON n.document_id = f.document_id AND n.i = f.i + 1) SELECT document_id, chunk_id, bin FROM f"""
)
def batch_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.bins(fx.chunks(spark, sf_dir), ["document_id"], ["ordinal"])


@query(
    f"""WITH {fx.CHUNKS}, b AS (SELECT CAST(document_id AS VARCHAR) AS query_id, ordinal + 1 AS rank, '[S' || (ordinal + 1) || '] file=' || file_name || ' chunk=' || chunk_id || ' chars=' || char_start || '-' || char_end || ' heading=' || heading_path || chr(10) || substring(content, 1, 700) || chr(10) || chr(10) AS block FROM ch), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b)
SELECT query_id, sha256(string_agg(block, '' ORDER BY rank)) AS context_sha256 FROM u WHERE used <= 3000 GROUP BY 1"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fx.chunks(spark, sf_dir).select(F.col("document_id").cast("string").alias("query_id"), (F.col("ordinal") + 1).alias("rank"), "file_name", "chunk_id", "char_start", "char_end", "heading_path", F.substring("content", 1, 700).alias("snippet"))
    return context.context_text(hits, 3000).select("query_id", F.sha2("context", 256).alias("context_sha256"))


# --- facts ---------------------------------------------------------------------------------------

_FACTS = """fact AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 500 AS chunk_id, ' ' || o_orderpriority AS scope, o_orderstatus AS subject, l_returnflag AS object, CASE WHEN l_discount > 0.05 THEN 'discount' ELSE ' ' END AS condition, l_linestatus AS effect, CASE WHEN l_tax > 0.06 THEN 'tax' ELSE '' END AS exception,
 CASE WHEN l_quantity > 45 THEN 'negative' ELSE 'positive' END AS polarity, 'line ' || l_linenumber AS statement, CASE WHEN l_linenumber = 1 THEN 'q' ELSE '' END AS quote, CASE WHEN l_linenumber % 3 = 0 THEN 'High' WHEN l_linenumber % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem").join(fx.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    third = F.col("l_linenumber") % 3
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_orderkey") % 500).alias("chunk_id"),
        F.concat(F.lit(" "), "o_orderpriority").alias("scope"),
        F.col("o_orderstatus").alias("subject"),
        F.col("l_returnflag").alias("object"),
        F.when(F.col("l_discount") > 0.05, "discount").otherwise(" ").alias("condition"),
        F.col("l_linestatus").alias("effect"),
        F.when(F.col("l_tax") > 0.06, "tax").otherwise("").alias("exception"),
        F.when(F.col("l_quantity") > 45, "negative").otherwise("positive").alias("polarity"),
        F.concat(F.lit("line "), "l_linenumber").alias("statement"),
        F.when(F.col("l_linenumber") == 1, "q").otherwise("").alias("quote"),
        F.when(third == 0, "High").when(third == 1, "medium").otherwise("low").alias("confidence"),
    )


@query(f"WITH {_FACTS} SELECT seq, chunk_id, statement FROM fact QUALIFY row_number() OVER (PARTITION BY chunk_id, trim(scope), trim(subject), trim(object), trim(condition), trim(effect), trim(exception), trim(polarity) ORDER BY seq) = 1")
def fact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.unique_facts(_facts(spark, sf_dir)).select("seq", "chunk_id", "statement")


@query(
    f"""WITH {_FACTS}, h AS (SELECT *, concat_ws(' ', scope, subject, object, condition, effect, exception, statement, quote) AS t FROM fact), s AS (SELECT seq, CASE WHEN contains(lower(t), 'urgent') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(t), 'tax') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(t, 'discount') THEN 3.0 ELSE 0.0 END + CASE lower(confidence) WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 ELSE 0.0 END + CASE WHEN trim(exception) <> '' THEN 2.5 ELSE 0.0 END + CASE WHEN polarity = 'negative' THEN 2.0 ELSE 0.0 END + CASE WHEN trim(condition) <> '' THEN 1.5 ELSE 0.0 END + CASE WHEN trim(quote) <> '' THEN 0.8 ELSE 0.0 END AS score FROM h)
SELECT seq, CAST(score AS DOUBLE) AS score FROM s ORDER BY score DESC, seq LIMIT 120"""
)
def fact_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.reduce_facts(_facts(spark, sf_dir), F.array(F.lit("urgent"), F.lit("TAX")), F.array(F.lit("discount"))).select("seq", "score")


@query(
    f"""WITH {_FACTS}, w AS (SELECT unnest(list_filter([lower(object), lower(subject), lower(trim(condition)), lower(effect), lower(exception)], lambda x: length(x) >= 2)) AS q FROM (SELECT * FROM fact ORDER BY seq LIMIT 120)), p AS (SELECT trim(object) || ' ' || trim(condition) AS q FROM (SELECT * FROM fact ORDER BY seq LIMIT 120) WHERE trim(condition) <> '' UNION ALL SELECT trim(object) || ' ' || effect FROM (SELECT * FROM fact ORDER BY seq LIMIT 120))
SELECT DISTINCT q AS query FROM (SELECT q FROM w WHERE q <> 'tax' UNION ALL SELECT q FROM p) ORDER BY q LIMIT 40"""
)
def followup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.followup_queries(_facts(spark, sf_dir), F.array(F.lit("tax")))


# Replies in the shapes a model gives: plain, within prose, without the array, not JSON at all.
def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    item = F.concat(F.lit('{"facts":[{"chunk_id":'), F.col("event_id") + 1, F.lit(',"statement":" '), "event_type", F.lit(' ","object":5,"condition":"","effect":"x","polarity":"'), F.when(F.col("value") > 50, "NEGATIVE").otherwise("?"), F.lit('"},{"chunk_id":-1,"statement":"elsewhere"},{"chunk_id":"'), F.col("event_id"), F.lit('","statement":"text id"},{"chunk_id":'), F.col("event_id"), F.lit("}]}"))
    raw = F.when(F.col("user_id") % 4 == 0, item).when(F.col("user_id") % 4 == 1, F.concat(F.lit("Here you are: "), item, F.lit(" - done"))).when(F.col("user_id") % 4 == 2, '{"other":[]}').otherwise("no json")
    return e.select(F.col("event_id").alias("batch_id"), raw.alias("raw"), F.col("event_type"))


@query("SELECT event_id AS batch_id, event_id + 1 AS chunk_id, event_type AS statement, CASE WHEN value > 50 THEN 'negative' ELSE 'positive' END AS polarity, 'medium' AS confidence, 'f' || event_id || ' / h' AS scope, '' AS object FROM events WHERE user_id % 4 < 2")
def facts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir)
    batch = r.select("batch_id", (F.col("batch_id") + 1).alias("chunk_id"), F.concat(F.lit("f"), "batch_id").alias("file_name"), F.lit("").alias("path"), F.lit("h").alias("heading_path"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"))
    return facts.facts_from_replies(r, batch).select("batch_id", "chunk_id", "statement", "polarity", "confidence", "scope", "object")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN array_to_string(list_sort(list_distinct([user_id % 9 + 1, 2, 2])), ',') ELSE NULL END AS kept FROM events")
def keep_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    good = F.concat(F.lit('```json {"keep_indexes":['), F.col("user_id") % 9 + 1, F.lit(",2,2]} ```"))
    raw = F.when(F.col("user_id") % 3 == 0, good).when(F.col("user_id") % 3 == 1, '{"keep_indexes":[0,999]}').otherwise('{"keep_indexes":["1"]}')
    return e.select("event_id", F.array_join(facts.keep_indexes(raw, F.lit(10)).cast("array<string>"), ",").alias("kept"))


# --- audits and metrics --------------------------------------------------------------------------


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    verdict = F.when(F.col("user_id") % 4 == 0, "pass").when(F.col("user_id") % 4 == 1, "WARNING").when(F.col("user_id") % 4 == 2, "warning").otherwise("fail")
    claims = F.when(F.col("value") > 50, '["a","b"]').otherwise("[]")
    json = F.concat(F.lit('{"verdict":"'), verdict, F.lit('","unsupported_claims":'), claims, F.lit(',"scope_errors":[{"claim":"x"}],"insufficient_evidence_overreach":[]}'))
    plain = F.when(F.col("event_id") % 5 == 0, "not json").when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"verdict":"'), verdict, F.lit('"}'))).otherwise(json)
    return e.select("event_id", plain.alias("audit"), F.when(F.col("event_id") % 2 == 0, plain).alias("again"))


_AUDIT = "a AS (SELECT event_id, value, user_id, event_id % 5 AS kind, CASE user_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'warning' ELSE 'fail' END AS verdict FROM events)"


@query(f"WITH {_AUDIT} SELECT event_id, kind <> 0 AND (kind <> 1 OR verdict <> 'pass') AS revise FROM a")
def audit_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).select("event_id", evaluate.needs_revision("audit").alias("revise"))


@query(
    f"""WITH {_AUDIT}, c AS (SELECT event_id, CASE WHEN kind > 1 AND value > 50 THEN 2 ELSE 0 END AS u, CASE WHEN kind > 1 THEN 1 ELSE 0 END AS s, CASE WHEN kind = 0 THEN 'unknown' ELSE verdict END AS verdict FROM a)
SELECT event_id AS run_id, round(CAST(least(1.0, greatest(0.0, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CASE WHEN event_id % 2 = 0 THEN 0.45 ELSE 0.225 END + CASE WHEN event_id % 4 = 0 THEN 0.55 * 0.5 ELSE 0.35 END + CASE WHEN event_id % 6 = 1 THEN 0.15 ELSE 0 END END)) AS DOUBLE), 6) AS context_recall, round(CAST(greatest(0.0, CASE verdict WHEN 'pass' THEN 1.0 WHEN 'warning' THEN 0.65 WHEN 'fail' THEN 0.25 ELSE 0.75 END - 0.12 * u - 0.14 * s) AS DOUBLE), 6) AS faithfulness,
 CAST(0.8 * 1 / 3 + 0.2 AS DECIMAL(12, 6))::DOUBLE AS answer_relevance, CAST(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS concept_coverage, u AS unsupported_count, 0 AS relationship_error_count, s AS scope_error_count, 0 AS polarity_error_count, verdict FROM c"""
)
def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made from events; a third have no facts, and one of two concepts is in the facts of the others."""
    e = F.col("event_id")
    fact = F.array(F.struct(e.alias("chunk_id"), F.lit("coverage of alpha").alias("object"), F.lit("").alias("scope"), F.lit("").alias("statement")))
    none = F.filter(fact, lambda f: F.lit(False))
    runs = _audits(spark, sf_dir).select(
        e.alias("run_id"), F.lit("total").alias("question"), F.lit("the total is so").alias("answer"), "audit", F.array(F.lit("total")).alias("terms"), F.array(F.lit("alpha"), F.lit("omega")).alias("lower_concepts"), (e % 4 == 0).alias("is_broad"),
        F.when(e % 3 == 0, none).otherwise(fact).alias("facts"), F.when(e % 2 == 0, F.array(e)).otherwise(F.array().cast("array<bigint>")).alias("hit_chunks"), (e % 6 == 1).alias("has_sections"),
    )
    return evaluate.metrics(runs)


# --- chats and events ----------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role FROM conversations WHERE trim(text) <> ''), g AS (SELECT conv_id, regexp_replace(trim(coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '')), '\\s+', ' ', 'g') AS x, count(*) AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_user, max(turn) AS last_turn FROM t GROUP BY 1)
SELECT conv_id, CASE WHEN x = '' THEN '新しいチャット' WHEN length(x) > 34 THEN substring(x, 1, 34) || '...' ELSE x END AS title, n_messages, n_user, last_turn FROM g"""
)
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.sessions(fx.table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, i - 1 AS seq, d[i] AS delta FROM (SELECT doc_id, d, unnest(range(1, len(d) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]{0,79}\\n|[^\\n]{80}|[^\\n]+') AS d FROM documents))")
def answer_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document streamed as an answer."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chats.deltas("text")).alias("seq", "delta")).withColumn("seq", F.col("seq").cast("long"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN '仕上げています' WHEN event_type = 'error' THEN 'API制限の回復を待っています' WHEN event_type = 'view' THEN '関連しそうな資料を探しています' WHEN event_type = 'click' THEN CASE WHEN user_id % 10 = 0 THEN '根拠を抽出しています' WHEN (event_id % 10) / (user_id % 10) < 0.25 THEN '資料を読み始めています' WHEN (event_id % 10) / (user_id % 10) < 0.7 THEN '根拠を拾い集めています' ELSE '条件や例外を照合しています' END ELSE '処理しています' END AS title FROM events"""
)
def progress_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    stage = F.when(t == "click", "extract").when(t == "error", "api").when(t == "view", "retrieve").otherwise("other")
    title = chats.progress_title(stage, F.when(t == "signup", "complete").otherwise("running"), F.when(t == "error", "制限").otherwise(""), F.col("event_id") % 10, F.col("user_id") % 10, F.lit("extract"))
    return fx.table(spark, sf_dir, "events").select("event_id", title.alias("title"))


@query("SELECT event_id, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'rate_limit' WHEN s = 400 AND user_id % 2 = 0 THEN 'context_limit' WHEN s = 413 THEN 'context_limit' WHEN s >= 500 THEN 'server' ELSE 'api_error' END AS failure, CASE WHEN user_id % 3 = 0 THEN (user_id % 20) * 1000 ELSE NULL END AS retry_ms FROM (SELECT *, [400, 401, 403, 404, 413, 429, 500, 503][event_id % 8 + 1] AS s FROM events)")
def api_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, (400, 401, 403, 404, 413, 429, 500, 503))), (F.col("event_id") % 8 + 1).cast("int"))
    message = F.when(F.col("user_id") % 2 == 0, "Context too long").otherwise("bad")
    raw = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" "), (F.col("user_id") % 20).cast("string"))).otherwise("soon")
    return e.select("event_id", tx.failure_class(status, message).alias("failure"), tx.retry_after_ms(raw).alias("retry_ms"))

"""The driver's tables as relations of the engine, and the same as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.chunking import CHUNK_STRIDE, linked

WINDOW = 1200  # characters of a fixed window, the simple chunking of these queries
QUESTIONS = {"q1": "the thand and then", "q2": "que ouch les Eau", "q3": "und der einheit src3 API"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: id, path, file_name, size, mtime_ms, sha256, char_count, selected, status, text."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.join(labels, "doc_id", "left")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), name).alias("path"),
        name.alias("file_name"),
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 1000).alias("mtime_ms"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("char_count"),
        ((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("selected"),
        F.lit("indexed").alias("status"),
        F.concat("lang", F.lit(" > "), "source").alias("heading"),
        "text",
    )


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("selected").select(F.col("id").alias("document_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of each document. One row group a file makes one task, so rows are dealt out first."""
    d = documents(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    n = F.greatest(F.ceil(F.length("text") / WINDOW), F.lit(1)).cast("int")
    rows = d.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
    out = rows.select(
        (F.col("id") * CHUNK_STRIDE + F.col("ordinal")).alias("chunk_id"),
        F.col("id").alias("document_id"),
        "file_name",
        "path",
        "ordinal",
        F.col("heading").alias("heading_path"),
        (F.col("ordinal") * WINDOW).alias("char_start"),
        F.least((F.col("ordinal") + 1) * WINDOW, F.length("text").cast("long")).alias("char_end"),
        F.substring("text", F.col("ordinal").cast("int") * WINDOW + 1, F.lit(WINDOW)).alias("content"),
    )
    return linked(out)


DOCS = """docs AS (SELECT d.doc_id AS id, '/corpus/' || source || '/' || d.doc_id || '.txt' AS path, d.doc_id || '.txt' AS file_name, CAST(octet_length(encode(text)) AS BIGINT) AS size,
  d.doc_id * 1000 AS mtime_ms, sha256(text) AS sha256, n_chars AS char_count, coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AS selected, 'indexed' AS status, lang || ' > ' || source AS heading, text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
CHUNKS = f"""{DOCS},
win AS (SELECT *, unnest(range(0, CAST(greatest(ceil(length(text) / {WINDOW}.0), 1) AS BIGINT))) AS ordinal FROM docs),
ch AS (SELECT id * {CHUNK_STRIDE} + ordinal AS chunk_id, id AS document_id, file_name, path, ordinal, heading AS heading_path, ordinal * {WINDOW} AS char_start,
  least((ordinal + 1) * {WINDOW}, length(text)) AS char_end, substring(text, CAST(ordinal * {WINDOW} + 1 AS BIGINT), {WINDOW}) AS content, selected FROM win)"""


def terms_sql(text: str) -> str:
    """Distinct terms of a text of ASCII words and other letters, unordered."""
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_-]+'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 40))"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({text})), '[\\p{{L}}\\p{{N}}]+')"


REQUESTS = "req AS (SELECT query_id, query, list_sort(" + terms_sql("query") + ") AS terms FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in QUESTIONS.items()) + ") t(query_id, query))"

FTS = (
    r"""phr AS (SELECT query_id, phrase, """
    + tokens_sql("phrase")
    + r""" AS toks FROM (SELECT query_id, unnest(list_sort(list_distinct(list_filter(list_concat([trim(query)], terms[1:12]), lambda x: length(x) >= 2)))[1:10]) AS phrase FROM req)),
tk AS (SELECT chunk_id, document_id, """
    + tokens_sql("content")
    + " AS t0, "
    + tokens_sql("heading_path")
    + " AS t1, "
    + tokens_sql("file_name")
    + r""" AS t2 FROM ch),
fld AS (SELECT chunk_id, document_id, ' ' || array_to_string(t0, '  ') || ' ' AS s FROM tk UNION ALL SELECT chunk_id, document_id, ' ' || array_to_string(t1, '  ') || ' ' FROM tk UNION ALL SELECT chunk_id, document_id, ' ' || array_to_string(t2, '  ') || ' ' FROM tk),
up AS (SELECT DISTINCT phrase, ' ' || array_to_string(toks, '  ') || ' ' AS p FROM phr WHERE len(toks) > 0),
tf AS (SELECT phrase, chunk_id, document_id, sum((length(s) - length(replace(s, p, ''))) / length(p)) AS f FROM fld, up WHERE contains(s, p) GROUP BY ALL),
sz AS (SELECT chunk_id, len(t0) + len(t1) + len(t2) AS dl FROM tk),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sz),
idf AS (SELECT phrase, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf, avgdl FROM tf, st GROUP BY phrase, n, avgdl),
bm AS (SELECT query_id, tf.chunk_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm25 FROM tf JOIN docs ON docs.id = tf.document_id AND docs.selected JOIN idf USING (phrase) JOIN sz ON sz.chunk_id = tf.chunk_id
  JOIN (SELECT query_id, phrase FROM phr) USING (phrase) GROUP BY query_id, tf.chunk_id),
fts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS rank, 1 / (1 + abs(bm25)) AS score FROM bm QUALIFY rank <= 180)"""
)
TERMS = f"""te AS (SELECT term, chunk_id, least(sum(CASE WHEN length(term) >= 4 THEN 2.0 ELSE 1.0 END * times), 12.0) AS weight FROM (SELECT chunk_id, unnest({terms_sql("content")}) AS term, 1.0 AS times FROM ch
  UNION ALL SELECT chunk_id, unnest({terms_sql("heading_path")}), 2.0 FROM ch) GROUP BY ALL)"""
NGRAM = """ng AS (SELECT query_id, chunk_id, sum(weight) AS score FROM te JOIN (SELECT query_id, unnest(terms[1:60]) AS term FROM req) USING (term) JOIN ch USING (chunk_id) WHERE selected GROUP BY ALL),
ngram AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ng QUALIFY rank <= 220)"""


def hash_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs: name(key, dim, value)."""
    byte = lambda k: f"CAST('0x' || substr(h, {2 * k + 1}, 2) AS BIGINT)"
    return f"""{name}_h AS (SELECT {key}, term, sha256(term) AS h FROM (SELECT {key}, unnest({terms_sql(text)}) AS term FROM {source})),
{name}_s AS (SELECT {key}, CAST(({byte(0)} + {byte(1)} * 256 + {byte(2)} * 65536 + {byte(3)} * 16777216) % 384 AS INTEGER) AS dim, sum(CASE WHEN {byte(4)} % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN length(term) >= 4 THEN 2.0 ELSE 1.0 END) AS raw FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {key}, dim, CAST(CAST(raw AS FLOAT) / CAST(sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS FLOAT) AS FLOAT) AS value FROM {name}_s WHERE raw <> 0)"""


VECTOR = (
    hash_sql("ve", "ch", "chunk_id", "heading_path || chr(10) || content")
    + ",\n"
    + hash_sql("vq", "req", "query_id", "query")
    + """,
dot AS (SELECT query_id, ch.chunk_id, round(coalesce(s, 0.0), 6) AS score FROM ch CROSS JOIN req LEFT JOIN (SELECT query_id, chunk_id, sum(CAST(ve.value AS DOUBLE) * CAST(vq.value AS DOUBLE)) AS s FROM ve JOIN vq USING (dim) GROUP BY ALL) x USING (query_id, chunk_id) WHERE selected),
vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dot QUALIFY rank <= 220)"""
)
FUSE = """fuse AS (SELECT query_id, chunk_id, sum(w / (60 + rank)) AS rrf, coalesce(max(CASE WHEN r = 'fts' THEN score END), 0.0) AS fts_score, coalesce(max(CASE WHEN r = 'ngram' THEN score END), 0.0) AS ngram_score, coalesce(max(CASE WHEN r = 'vector' THEN score END), 0.0) AS vector_score
  FROM (SELECT query_id, chunk_id, 'fts' AS r, CAST(1.0 AS DOUBLE) AS w, score, rank FROM fts UNION ALL SELECT query_id, chunk_id, 'ngram', 1.15, score, rank FROM ngram UNION ALL SELECT query_id, chunk_id, 'vector', 0.95, score, rank FROM vector) GROUP BY ALL)"""


def bonus_sql(text: str) -> str:
    return f"least(0.45, CASE WHEN length(trim(query)) > 0 AND contains({text}, trim(query)) THEN 0.18 ELSE 0.0 END + coalesce(list_sum(list_transform(terms[1:30], lambda t: CASE WHEN contains({text}, t) THEN CASE WHEN length(t) >= 4 THEN 0.045 ELSE 0.02 END ELSE 0.0 END)), 0.0))"


def scored_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, round(rrf + exact_bonus + heading_bonus + ngram_score * 0.004 + greatest(vector_score, 0.0) * 0.08 + fts_score * 0.03, 9) AS score FROM
  (SELECT f.*, ch.* EXCLUDE (chunk_id), terms, CAST({bonus_sql("content")} AS DOUBLE) AS exact_bonus, CAST({bonus_sql("heading_path")} AS DOUBLE) * 1.4 AS heading_bonus FROM {source} f JOIN req USING (query_id) JOIN ch USING (chunk_id)))"""


def hybrid_sql(limit: int) -> str:
    return f"""{scored_sql("s1", "fuse")},
best AS (SELECT query_id, chunk_id, document_id, ordinal FROM s1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {2 * limit}),
near AS (SELECT DISTINCT query_id, c.chunk_id FROM best b JOIN ch c ON c.document_id = b.document_id AND abs(c.ordinal - b.ordinal) = 1 WHERE (query_id, c.chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM fuse)),
cand AS (SELECT * FROM fuse UNION ALL SELECT query_id, chunk_id, 0.003, 0.0, 0.0, 0.0 FROM near),
{scored_sql("s2", "cand")},
low AS (SELECT * EXCLUDE (score), round(CASE WHEN row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) > 3 THEN score * 0.86 ELSE score END, 9) AS score FROM s2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM low QUALIFY rank <= {limit})"""


BASE = f"WITH {CHUNKS},\n{REQUESTS}"

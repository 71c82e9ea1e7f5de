"""The catalogue of documents: incremental upserts, missing files, selection, statistics, runs.

Tables are values: each operation gives the new table. SnapshotStore keeps them as Parquet, a
directory a version, with a pointer that is written last.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import trim
from tessella.scratch import materialise

MISSING = "source file is missing"

# The evaluation set that a new store begins with.
EVALUATION_ITEMS = [
    ("手当はどうなっていますか", ["手当"]),
    ("休暇はどうなっていますか", ["休暇"]),
    ("申請や届出の手続きはどうなっていますか", ["申請", "届出", "手続"]),
    ("対象者や対象外はどうなっていますか", ["対象", "対象外"]),
    ("例外やただし書きはありますか", ["例外", "ただし"]),
]


def unchanged(scanned: DataFrame, known: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scanned files (path, size, mtime_ms, sha256) that the catalogue has just so, with at least one chunk. An empty file has none, so it is never unchanged."""
    with_chunks = known.join(chunks.select(F.col("document_id").alias("id")), "id", "left_semi")
    return scanned.join(with_chunks.select("path", "size", "mtime_ms", "sha256"), ["path", "size", "mtime_ms", "sha256"], "left_semi")


def changed(scanned: DataFrame, known: DataFrame, chunks: DataFrame) -> DataFrame:
    same = unchanged(scanned, known, chunks)
    return scanned.join(same.select("path"), "path", "left_anti")


def upsert(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalogue with fresh rows by path: new ones get ids after the largest, in the order of their paths, and are selected; known ones keep id and selection."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    old = known.select("path", F.col("id").alias("_id"), F.col("selected").alias("_selected"))
    rows = fresh.drop("id", "selected").join(old, "path", "left").crossJoin(F.broadcast(top))
    new = F.col("_id").isNull()
    # ranks of new paths by range partition, without a single task
    nth = _dense_order(rows.where(new).select("path"), "path")
    rows = rows.join(nth, "path", "left")
    merged = rows.withColumn("id", F.coalesce("_id", F.col("_top") + F.col("_nth"))).withColumn("selected", F.coalesce("_selected", F.lit(True)))
    rest = known.join(fresh.select("path"), "path", "left_anti")
    return rest.unionByName(merged.select(*known.columns))


def _dense_order(df: DataFrame, column: str) -> DataFrame:
    """Adds _nth, 1 for the least value: rank in a range partition plus the sizes of those before it."""
    parts = materialise(df.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranges")  # bounds are sampled once
    before = parts.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    nth = F.row_number().over(W.partitionBy("_p").orderBy(column))
    return parts.withColumn("_r", nth).join(F.broadcast(before), "_p").select(column, (F.col("_r") + F.col("_before")).cast("long").alias("_nth"))


def replace_children(old: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of a child table with those of the given documents (document_id) replaced."""
    return old.join(documents.select("document_id"), "document_id", "left_anti").unionByName(fresh)


def mark_missing(known: DataFrame, scanned: DataFrame, heal: bool = False) -> DataFrame:
    """Documents whose path was not scanned get status missing. One that is back stays missing until it is indexed anew, unless heal."""
    here = scanned.select("path", F.lit(True).alias("_here"))
    rows = known.join(here, "path", "left")
    gone = F.col("_here").isNull()
    status = F.when(gone, "missing")
    if heal:
        status = status.when(F.col("status") == "missing", "indexed")
    return rows.withColumn("error", F.when(gone, MISSING).otherwise(F.col("error"))).withColumn("status", status.otherwise(F.col("status"))).select(*known.columns)


def with_errors(known: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed files (path, message) get status error; the rest is as before."""
    rows = known.join(failed.select("path", F.col("message").alias("_message")), "path", "left")
    bad = F.col("_message").isNotNull()
    return rows.withColumn("status", F.when(bad, "error").otherwise(F.col("status"))).withColumn("error", F.when(bad, F.col("_message")).otherwise(F.col("error"))).select(*known.columns)


def with_chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The catalogue for display: chunk_count, in order of file name."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    return docs.join(counts, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy("file_name", "id")


def stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents and characters, all and selected; chunks, all and of selected documents."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    rows = docs.join(counts, "id", "left")
    total = lambda c, keep=None: F.coalesce(F.sum(c if keep is None else F.when(keep, F.col(c))), F.lit(0)).cast("long")
    chosen = F.col("selected")
    return rows.agg(
        F.count("*").alias("document_count"),
        F.count_if(chosen).alias("selected_document_count"),
        total("char_count").alias("total_chars"),
        total("char_count", chosen).alias("selected_chars"),
        total("n").alias("chunk_count"),
        total("n", chosen).alias("selected_chunk_count"),
    )


def select_one(docs: DataFrame, doc_id: int, on: bool) -> DataFrame:
    return docs.withColumn("selected", F.when(F.col("id") == doc_id, F.lit(on)).otherwise(F.col("selected")))


def select_all(docs: DataFrame) -> DataFrame:
    """Selects all but missing documents; these stay as they are."""
    return docs.withColumn("selected", F.when(F.col("status") != "missing", F.lit(True)).otherwise(F.col("selected")))


def select_none(docs: DataFrame) -> DataFrame:
    return docs.withColumn("selected", F.lit(False))


def resolve_selection(docs: DataFrame, requested: list[int] | None = None) -> DataFrame:
    """(document_id): the requested ids just as they are, or the selected and indexed documents."""
    if requested:
        return docs.sparkSession.createDataFrame([(i,) for i in requested], "document_id long")
    return docs.where(F.col("selected") & (F.col("status") == "indexed")).select(F.col("id").alias("document_id"))


def fetch_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks by id (chunk_id)."""
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi")


def selected_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunks of the documents (document_id) in reading order."""
    return chunks.join(documents, "document_id", "left_semi").orderBy("file_name", "document_id", "ordinal")


def needs_backfill(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Indexed documents without a rollup."""
    return docs.where("status = 'indexed'").join(contexts.select(F.col("document_id").alias("id")), "id", "left_anti")


def latest_runs(events: DataFrame) -> DataFrame:
    """The state of each run from its appended rows (run_id, at, seq, status): what it began with and what came last."""
    order = F.struct("at", "seq")
    return events.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max_by("status", order).alias("status"), F.max("at").alias("updated_at"), F.count("*").alias("n_events"))


def add_missing_items(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """Evaluation items with those seeds whose question isn't there yet."""
    return items.unionByName(seeds.join(items.select("question"), "question", "left_anti").select(*items.columns))


def find_items(items: DataFrame, questions: DataFrame) -> DataFrame:
    """questions with the id of the active item of the same trimmed question, or null."""
    active = items.where("active").select(F.col("id").alias("item_id"), F.col("question").alias("_q"))
    return questions.join(active, trim(F.col("question")) == F.col("_q"), "left").drop("_q")


class SnapshotStore:
    """Tables as versions in a folder. Readers follow a pointer; it moves once, when all that belongs together is written.

    A child table of documents is kept in buckets of document ids, and a change writes only the
    buckets that it touches. A pointer is a small file with a number; the highest one counts, and
    two writers that began from the same one can't both move it.
    """

    BUCKETS, POINTERS_KEPT = 64, 5

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        target = self._path(path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(target)) if self._fs.exists(target) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._list(posixpath.join(self.root, "_CURRENT")) if n.isdigit()]

    def versions(self) -> dict[str, dict]:
        """name -> {schema, parts}, where parts are the folders that hold its rows."""
        names = self._pointers()
        return self._versions(names[-1]) if names else {}

    def _versions(self, name: str) -> dict[str, dict]:
        stream = self._fs.open(self._path(posixpath.join(self.root, "_CURRENT", name)))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, name: str, df: DataFrame) -> dict:
        """Writes a new version that no reader sees yet."""
        version = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(posixpath.join(self.root, version))
        return {"schema": df.schema.json(), "parts": {"": version}}

    def bucket(self, column: str = "document_id") -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.BUCKETS))

    def touched(self, documents: DataFrame) -> list[int]:
        """The buckets of some documents (document_id): at most as many as there are buckets."""
        return sorted(r[0] for r in documents.select(self.bucket()).distinct().collect())

    def stage_children(self, name: str, fresh: DataFrame, documents: DataFrame, touched: list[int]) -> dict:
        """A new version of a child table in which the rows of the given documents are replaced. Untouched buckets stay the files that they are."""
        now = self.versions().get(name, {"schema": fresh.schema.json(), "parts": {}})
        old = self.load(now, [p for k, p in now["parts"].items() if int(k) in touched])
        rows = replace_children(old, fresh.select(*old.columns), documents)
        version = f"{name}/v-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(posixpath.join(self.root, version))
        parts = {k: p for k, p in now["parts"].items() if int(k) not in touched}
        for folder in self._list(posixpath.join(self.root, version)):
            if folder.startswith("_bucket="):
                parts[folder.removeprefix("_bucket=")] = f"{version}/{folder}"
        return {"schema": now["schema"], "parts": parts}

    def load(self, entry: dict, parts: list[str] | None = None) -> DataFrame:
        """The rows of a staged or current version, or of some of its folders."""
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        parts = list(entry["parts"].values()) if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(posixpath.join(self.root, p) for p in sorted(parts)))

    def commit(self, entries: dict[str, dict]) -> None:
        """Moves the pointer to staged versions, all at once. Raises if another writer was first."""
        names = self._pointers()
        now = (self._versions(names[-1]) if names else {}) | entries
        folder, name = posixpath.join(self.root, "_CURRENT"), f"{int(names[-1]) + 1 if names else 1:020d}"
        draft, final = self._path(posixpath.join(folder, f".draft-{uuid.uuid4().hex}")), self._path(posixpath.join(folder, name))
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError("another writer has changed the store; begin again")
        for old in names[: -self.POINTERS_KEPT]:
            self._fs.delete(self._path(posixpath.join(folder, old)), False)

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Writes new versions of some tables and then moves the pointer to all of them at once."""
        self.commit({name: self.stage(name, df) for name, df in tables.items()})

    def read(self, name: str) -> DataFrame | None:
        entry = self.versions().get(name)
        return None if entry is None else self.load(entry)

    def vacuum(self) -> int:
        """Deletes versions that none of the kept pointers lead to; how many. Not while another writer is at work."""
        used = {p.split("/_bucket=")[0] for name in self._pointers() for e in self._versions(name).values() for p in e["parts"].values()}
        gone = [f"{name}/{v}" for name in self._list(self.root) if name not in ("_CURRENT", "log") for v in self._list(posixpath.join(self.root, name)) if f"{name}/{v}" not in used]
        for path in gone:
            self._fs.delete(self._path(posixpath.join(self.root, path)), True)
        return len(gone)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(posixpath.join(self.root, "log", name))

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.root, "log", name))

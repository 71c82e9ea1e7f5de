"""Entry points: index a folder, search it, answer a question from it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import is_broad, meaningful_terms, normalized, terms
from tessella.operators import catalog, chunking, context, evaluate, expand, facts, index, search
from tessella.operators.model import Client, OfflineClient, ask_in_waves, patiently
from tessella.operators.tasks import Tasks
from tessella.scratch import materialise
from tessella.sources.folder import read_files, read_folder

NO_EVIDENCE = "資料から根拠を確認できませんでした。"
EMPTY_QUESTION = "質問が空です。"
STOPPED = "ユーザーがキャンセルしました"
CATALOGUE = "id long, path string, file_name string, size long, mtime_ms long, sha256 string, char_count long, selected boolean, indexed_at timestamp, status string, error string"
SEARCH_LIMIT, ANSWER_LIMIT = 12, 16
MERGED_HITS = 48
KEY_VALUES = "key string, value string"
ITEMS = "id long, question string, expected_terms array<string>, active boolean"


class Cancelled(Exception):
    """The user stopped the task."""


@dataclass
class Settings:
    """Engine defaults; the sizes are bounds of the request side. Saved ones are clamped."""

    context_chars: int = context.CONTEXT_CHARS
    batch_chars: int = context.BATCH_CHARS
    mode: str = "comprehensive"
    heal_status: bool = False
    temperature: float = 0.1

    def clamped(self) -> Settings:
        within = lambda x, low, high: min(max(x, low), high)
        return replace(self, context_chars=within(self.context_chars, 3_000, 80_000), batch_chars=within(self.batch_chars, 2_000, 16_000), temperature=within(self.temperature, 0.0, 1.0))

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        """From stored values; what is missing or unreadable is the default."""
        known = {}
        for f in fields(cls):
            try:
                known[f.name] = json.loads(values[f.name])
            except (KeyError, ValueError):
                continue
        return cls(**known)


@dataclass
class Answer:
    run_id: str
    answer: str
    facts: list[dict]
    hits: list[dict]
    audit: str | None
    metrics: dict
    stages: list[dict] = field(default_factory=list)


@dataclass
class Profile:
    """What a question asks for: its terms and the model's, aspects, and concepts of the source."""

    terms: list[str]
    aspects: list[str]
    wanted: list[str]
    broad: bool
    concepts: list[str] = field(default_factory=list)


class Progress:
    """Events of one run, with the time since it began."""

    def __init__(self, run_id: str, on_event: Callable[[dict], None] | None, stopped: Callable[[], bool]):
        self.run_id, self.on_event, self.stopped, self.began, self.events = run_id, on_event, stopped, time.time(), []

    def __call__(self, stage: str, status: str = "running", message: str = "", completed: int = 0, total: int = 0) -> None:
        """Reports a stage. A running one raises if the task was cancelled."""
        running = status == "running"
        event = {"stage": stage, "status": status, "message": message, "run_id": self.run_id, "completed": completed, "total": total, "elapsed_ms": int(1000 * (time.time() - self.began)), "can_cancel": running}
        self.events.append(event)
        if self.on_event:
            self.on_event(event)
        if running and self.stopped():
            raise Cancelled(STOPPED)


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


class Corpus:
    """A stored corpus: catalogue, chunks and indexes as versions in one folder."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.store, self.tasks = spark, catalog.SnapshotStore(spark, root), Tasks(spark)
        self.settings = settings or self.load_settings()

    def table(self, name: str, schema: str = CATALOGUE) -> DataFrame:
        found = self.store.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    # --- settings, snapshot, evaluation items

    def load_settings(self) -> Settings:
        return Settings.of({r.key: r.value for r in self.table("settings", KEY_VALUES).collect()})

    def save_settings(self, settings: Settings) -> Settings:
        """Keeps clamped settings as keys and values, and uses them."""
        self.settings = settings.clamped()
        rows = [(k, json.dumps(v)) for k, v in asdict(self.settings).items()]
        self.store.write({"settings": self.spark.createDataFrame(rows, KEY_VALUES)})
        return self.settings

    def snapshot(self) -> dict:
        """Settings, the catalogue for display and its statistics."""
        docs, chunks = self.table("documents"), self.table("chunks", "document_id long")
        return {"settings": self.settings, "documents": catalog.with_chunk_counts(docs, chunks), "stats": catalog.stats(docs, chunks).first().asDict()}

    def evaluation_items(self) -> DataFrame:
        """The evaluation set; a new store gets the default items, and one that lacks some gets these."""
        items = self.table("evaluation_items", ITEMS)
        top = items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        seeds = self.spark.createDataFrame([(top + k, q, e, True) for k, (q, e) in enumerate(catalog.EVALUATION_ITEMS, 1)], ITEMS)
        merged = catalog.add_missing_items(items, seeds)
        if merged.count() > items.count():
            self.store.write({"evaluation_items": merged})
        return self.table("evaluation_items", ITEMS)

    # --- selection

    def select(self, doc_id: int | None, on: bool) -> None:
        """Selects one document or, without an id, all that aren't missing; or takes the selection away."""
        docs = self.table("documents")
        self.store.write({"documents": catalog.select_one(docs, doc_id, on) if doc_id is not None else catalog.select_all(docs) if on else catalog.select_none(docs)})

    def documents(self, requested: list[int] | None = None) -> DataFrame:
        return catalog.resolve_selection(self.table("documents"), requested)

    def chunks_of(self, ids: list[int]) -> DataFrame:
        """Chunks by id."""
        return catalog.fetch_chunks(self.store.read("chunks"), self.spark.createDataFrame([(i,) for i in ids], "chunk_id long"))

    # --- indexing

    def index_folder(self, folder: str, on_event: Callable[[dict], None] | None = None) -> dict:
        """Brings the store in line with a folder: only new and changed files are chunked and indexed; the rest stays the files that it is.

        Files are read once for their digests, and changed ones once more for their texts, whose
        digests count. All tables are written first and become current together, so a run that
        fails anywhere leaves the store as it was.
        """
        with self.tasks.run("index") as tag:
            progress = Progress(tag, on_event, lambda: self.tasks.cancelled(tag))
            progress("index", message="scan")
            seen = materialise(read_folder(self.spark, folder, text=False).drop("text"), "scan")
            known = catalog.mark_missing(self.table("documents"), seen, self.settings.heal_status)
            old_chunks = self.table("chunks", "document_id long")
            todo = materialise(catalog.changed(seen.where("error IS NULL"), known, old_chunks).select("path"), "changed")
            read = materialise(read_files(todo.repartition(max(1, todo.count() // 64))), "texts")
            progress("index", message="chunk", total=todo.count())
            good = read.where("error IS NULL")
            failed = materialise(seen.where("error IS NOT NULL").unionByName(read.where("error IS NOT NULL").drop("text")), "failed")
            fresh = good.select(F.lit(None).cast("long").alias("id"), "path", "file_name", "size", "mtime_ms", "sha256", "char_count", F.lit(True).alias("selected"), F.current_timestamp().alias("indexed_at"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error"))
            broken = failed.join(known.select("path"), "path", "left_anti").select(F.lit(None).cast("long").alias("id"), "path", "file_name", "size", "mtime_ms", "sha256", "char_count", F.lit(True).alias("selected"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit("error").alias("status"), "error")
            entries = {"documents": self.store.stage("documents", catalog.with_errors(catalog.upsert(known, fresh.unionByName(broken)), failed.select("path", F.col("error").alias("message"))))}
            docs = self.store.load(entries["documents"])
            now = docs.join(good.select("path", "text"), "path").select(F.col("id").alias("document_id"), "path", "file_name", "text")
            new = materialise(chunking.chunk_documents(now).join(now.select("document_id", "path", "file_name"), "document_id"), "chunks")
            progress("index", message="indexes", total=todo.count())
            entries |= self._children(docs, new, materialise(now.select("document_id"), "documents"))
            progress("index", message="commit", total=todo.count())
            self.store.commit(entries)
            out = {"scanned": seen.count(), "indexed": good.count(), "failed": failed.count()}
            out |= {"skipped": out["scanned"] - out["indexed"] - out["failed"], "chunk_count": self.store.read("chunks").count(), "elapsed_ms": int(1000 * (time.time() - progress.began))}
            progress("index", "complete", completed=out["indexed"], total=out["indexed"])
        self.log("index", "complete", "indexed", None, out)
        return out

    def _children(self, docs: DataFrame, new: DataFrame, changed: DataFrame) -> dict[str, dict]:
        """Staged versions of all tables that hang on documents, with the changed documents' rows replaced."""
        ix, of = search.Index.over(new), new.select("chunk_id", "document_id")
        tables = {"chunks": new, "postings": ix.postings, "lengths": ix.lengths.join(of, "chunk_id"), "terms": ix.terms.join(of, "chunk_id"), "vectors": ix.vectors, "sections": index.section_rollup(new), "contexts": index.document_rollup(docs, new)}
        touched = self.store.touched(changed)
        return {name: self.store.stage_children(name, df, changed, touched) for name, df in tables.items()}

    def backfill(self) -> int:
        """Rebuilds the rollups of indexed documents that have none; how many."""
        docs, chunks = self.table("documents"), self.store.read("chunks")
        if chunks is None:
            return 0
        lacking = materialise(catalog.needs_backfill(docs, self.table("contexts", "document_id long")).select(F.col("id").alias("document_id")).join(chunks, "document_id", "left_semi"), "lacking")
        n = lacking.count()
        if n:
            theirs, touched = chunks.join(lacking, "document_id", "left_semi"), self.store.touched(lacking)
            tables = {"sections": index.section_rollup(theirs), "contexts": index.document_rollup(docs, theirs)}
            self.store.commit({name: self.store.stage_children(name, df, lacking, touched) for name, df in tables.items()})
        return n

    # --- search

    def index(self) -> search.Index:
        r = self.store.read
        return search.Index(r("chunks"), r("postings"), r("lengths").drop("document_id"), r("terms").drop("document_id"), r("vectors"))

    def search(self, queries: dict[str, str], requested: list[int] | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
        return search.hybrid_search(search.requests(self.spark, queries), self.index(), self.documents(requested), limit)

    def _batched(self, queries: list[str], limit: int, requested: list[int] | None) -> DataFrame:
        """All sub-queries in one plan; seq is a query's place in the list."""
        hits = self.search({f"{k:04d}": q for k, q in enumerate(queries)}, requested, limit)
        return hits.select(F.lit("run").alias("run_id"), "chunk_id", "document_id", F.col("query_id").cast("long").alias("seq"), "score")

    def _corrected(self, question: str, profile: Profile, hits: list[dict], requested: list[int] | None) -> list[tuple[int, int, float]]:
        """(chunk_id, document_id, score) of the hits, with those of corrective queries if the hits don't do."""
        seeds = [(h["chunk_id"], h["document_id"], h["score"]) for h in hits]
        if hits and not expand.needs_correction(profile.broad, [h["score"] for h in hits]):
            return seeds
        row = self.spark.createDataFrame([(question,)], "q string")
        qs = row.select(expand.corrective_queries(F.col("q"), _array(profile.concepts), _array(profile.aspects), _array(profile.terms)).alias("q")).first().q
        seeded = self.spark.createDataFrame([("run", c, d, -1, s) for c, d, s in seeds], "run_id string, chunk_id long, document_id long, seq long, score double")
        merged = expand.corrective_merge(seeded.unionByName(self._batched(qs, expand.CORRECTIVE_LIMIT, requested)))
        return [(r.chunk_id, r.document_id, r.score) for r in merged.orderBy("rank").collect()]

    # --- answers

    def _profile(self, question: str, client: Client) -> Profile:
        """Terms of the question and of the model's reply, which are tokenised again and kept whole if short; aspects apart. Without a reply, the question's own."""
        try:
            reply = json.loads(patiently(client, "profile", question))
        except Exception:
            reply = {}
        reply = reply if isinstance(reply, dict) else {}
        given = {k: [x for x in reply.get(k) or [] if isinstance(x, str)] if isinstance(reply.get(k), list) else [] for k in ("terms", "aspects")}
        row = self.spark.createDataFrame([(question, given["terms"], given["aspects"])], "q string, t array<string>, a array<string>")
        read = lambda c, most: F.concat(F.flatten(F.transform(c, lambda x: terms(x))), F.filter(c, lambda x: F.length(x).between(2, most)))
        rows = row.select("q", is_broad("q", terms("q")).alias("broad"), normalized(F.concat(terms("q"), read("t", 40))).alias("terms"), normalized(read("a", 50)).alias("aspects"))
        got = rows.select("*", meaningful_terms("q", F.col("terms")).alias("wanted")).first()
        return Profile(got.terms, got.aspects, got.wanted, got.broad or reply.get("is_broad") is True)

    def _search_terms(self, profile: Profile) -> list[str]:
        return self.spark.range(1).select(normalized(_array([*profile.terms, *profile.aspects, *profile.concepts]))).first()[0]

    def _extract(self, chunks: DataFrame, docs: DataFrame, asked: str, about: Callable[[DataFrame], DataFrame], client: Client, progress: Progress, message: str) -> DataFrame:
        """Facts of all chunks, batch by batch, with seq in the order of batches. about gives each batch's context."""
        binned = context.bins(chunks, ["document_id"], ["ordinal"], self.settings.batch_chars).join(chunks.drop("document_id"), "chunk_id")
        binned = materialise(binned.withColumn("batch_id", F.col("document_id") * 10_000 + F.col("bin")), "batches")
        shown = F.format_string("<<chunk %d>>\nfile=%s chars=%d-%d heading=%s\n%s\n", "chunk_id", "file_name", "char_start", "char_end", "heading_path", "content")
        prompts = binned.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", shown.alias("shown")))).alias("parts"))
        prompts = prompts.join(about(binned), "batch_id").select("batch_id", F.concat(F.lit(asked + "\n"), "context", F.lit("\n"), F.array_join(F.col("parts").getField("shown"), "")).alias("prompt"))
        prompts = materialise(prompts, "prompts")
        total = prompts.count()

        def save(df: DataFrame) -> DataFrame:
            progress("extract", message=message, total=total)  # also where a cancelled run stops
            return materialise(df, "replies")

        replies = ask_in_waves(prompts, "extract", client, save)
        unread = replies.where(F.col("raw").isNotNull() & ~facts.has_facts("raw"))
        if not unread.isEmpty():  # the model repairs what can't be read here
            again = ask_in_waves(unread.select("batch_id", F.col("raw").alias("prompt")), "repair_facts", client, save)
            replies = replies.join(unread.select("batch_id"), "batch_id", "left_anti").unionByName(again)
        found = facts.facts_from_replies(replies, binned.select("batch_id", "chunk_id", "file_name", "path", "heading_path", "char_start", "char_end"))
        return facts.unique_facts(found.withColumn("seq", F.struct("batch_id", "nth"))).withColumn("seq", F.col("batch_id") * 1000 + F.col("nth"))

    def _reduce(self, got: DataFrame, question: str, profile: Profile, client: Client) -> list[dict]:
        """At most 120 facts in order: of more, those that the model keeps; if its reply is unreadable or empty, the best by score."""
        rows = [r.asDict() for r in facts.reduce_facts(got, _array(profile.wanted), _array(profile.concepts), got.count()).orderBy("seq").collect()]
        if len(rows) <= facts.KEPT_FACTS:
            return rows
        shown = "\n".join(f"[F{k}] chunk={r['chunk_id']} file={r['file_name']} heading={r['heading_path']} " + " ".join(f"{n}={r[n]}" for n in [*facts.IDENTITY, "confidence", "statement", "quote"]) for k, r in enumerate(rows, 1))

        def indexes(raw: str) -> list[int] | None:
            return self.spark.createDataFrame([(raw,)], "raw string").select(facts.keep_indexes("raw", F.lit(len(rows)))).first()[0]

        raw = patiently(client, "reduce", f"{question}\nbroad: {profile.broad}\nconcepts: {', '.join(profile.concepts[:80])}\nat most: {facts.KEPT_FACTS}\n{shown}")
        kept = indexes(raw)
        if kept is None:
            try:
                kept = indexes(patiently(client, "repair_indexes", raw))
            except Exception:
                kept = None
        if kept:
            return [rows[k - 1] for k in kept[: facts.KEPT_FACTS]]
        return sorted(sorted(rows, key=lambda r: (-r["score"], r["seq"]))[: facts.KEPT_FACTS], key=lambda r: r["seq"])

    def _fact_texts(self, listed: list[dict]) -> str:
        """Facts as prompts show them, in order."""
        names = ["file_name", "chunk_id", "char_start", "char_end", "heading_path", *facts.TEXT_FIELDS]
        schema = "index int, " + ", ".join(f"{n} {'long' if n in ('chunk_id', 'char_start', 'char_end') else 'string'}" for n in names)
        rows = self.spark.createDataFrame([(k, *(f[n] for n in names)) for k, f in enumerate(listed, 1)], schema)
        return "".join(r[0] for r in rows.orderBy("index").select(facts.fact_text()).collect())

    def answer(self, question: str, requested: list[int] | None = None, client: Client | None = None, on_event: Callable[[dict], None] | None = None) -> Answer:
        """An answer with its evidence, audit and metrics; the run, its question, facts, answer and end are appended to the store's log.

        In mode comprehensive, all selected chunks are read for facts, with follow-up searches, and the
        answer is made of these, audited and revised; in mode normal, it is made of the hits and audited
        against them. tasks.cancel() stops it: the run's last status is cancelled, and Cancelled is raised.
        """
        if not question.strip():
            raise ValueError(EMPTY_QUESTION)
        client, run_id = client or OfflineClient(), str(uuid.uuid4())
        self._append("questions", "run_id string, text string", [(run_id, question)])
        self._run(run_id, 0, "running", None, requested)
        with self.tasks.run("answer") as tag:
            progress = Progress(run_id, on_event, lambda: self.tasks.cancelled(tag))
            try:
                progress("retrieve")
                hits = [r.asDict() for r in self.search({"q": question}, requested, ANSWER_LIMIT).orderBy("rank").collect()]
                work = self._normal if self.settings.mode == "normal" else self._comprehensive
                out = work(question, requested, client, run_id, progress, hits)
            except Exception as e:
                stopped = self.tasks.cancelled(tag)
                self._run(run_id, 1, "cancelled" if stopped else "failed", STOPPED if stopped else str(e)[:2000], requested)
                progress("answer", "cancelled" if stopped else "failed", str(e)[:200])
                if stopped and not isinstance(e, Cancelled):
                    raise Cancelled(STOPPED) from e
                raise
        self._append("answers", "run_id string, answer string, audit string", [(run_id, out.answer, out.audit)])
        self._append("facts", "run_id string, chunk_id long, fact string, quote string", [(run_id, f["chunk_id"], json.dumps(f, ensure_ascii=False, default=str), f["quote"]) for f in out.facts])
        self._run(run_id, 1, "complete", None, requested)
        progress("complete", "complete", total=len(out.answer))
        out.stages = progress.events
        return out

    def _measured(self, run_id: str, question: str, text: str, audit: str | None, profile: Profile, listed: list[dict], hits: list[int], has_sections: bool) -> dict:
        run = self.spark.createDataFrame(
            [(run_id, question, text, audit, profile.terms, profile.concepts, profile.broad, [(f["chunk_id"], f["object"], f["scope"], f["statement"]) for f in listed], hits, has_sections)],
            "run_id string, question string, answer string, audit string, terms array<string>, lower_concepts array<string>, is_broad boolean, facts array<struct<chunk_id:long,object:string,scope:string,statement:string>>, hit_chunks array<long>, has_sections boolean",
        )
        items = self.spark.createDataFrame([(question,)], "question string")
        measured = evaluate.metrics(run)
        self.store.append("metrics", measured.crossJoin(catalog.find_items(self.evaluation_items(), items).select("item_id").limit(1)))
        return measured.first().asDict()

    def _normal(self, question: str, requested: list[int] | None, client: Client, run_id: str, progress: Progress, hits: list[dict]) -> Answer:
        """An answer from the hits alone."""
        progress("answer", total=1)
        source = ""
        if hits:
            shown = self.spark.createDataFrame([("q", h["rank"], h["file_name"], h["chunk_id"], h["char_start"], h["char_end"], h["heading_path"], h["snippet"]) for h in hits], "query_id string, rank int, file_name string, chunk_id long, char_start long, char_end long, heading_path string, snippet string")
            found = context.context_text(shown, self.settings.context_chars).first()
            source = found.context if found else ""
        text = patiently(client, "answer_hits", f"{question}\n{source}")
        try:
            audit = patiently(client, "audit_hits", f"{text}\n{source}")
        except Exception:
            audit = None
        row = self.spark.createDataFrame([(question,)], "q string").select(terms("q").alias("t"), is_broad("q", terms("q")).alias("b")).first()
        profile = Profile(row.t, [], [], row.b)
        return Answer(run_id, text, [], hits, audit, self._measured(run_id, question, text, audit, profile, [], [h["chunk_id"] for h in hits], False))

    def _comprehensive(self, question: str, requested: list[int] | None, client: Client, run_id: str, progress: Progress, hits: list[dict]) -> Answer:
        """An answer from the facts of all selected chunks."""
        spark, docs = self.spark, self.documents(requested)
        chunks = catalog.selected_chunks(self.store.read("chunks"), docs)
        progress("profile")
        profile = self._profile(question, client)
        row = spark.createDataFrame([("q", question, profile.terms)], "query_id string, query string, terms array<string>")
        found = expand.source_concepts(chunks, row).first()
        profile.concepts = found.concepts if found else []
        progress("retrieve", message="corrective")
        best = self._corrected(question, profile, hits, requested)

        searched = self._search_terms(profile)
        above = self.store.read("contexts"), self.store.read("sections")
        documents, sections = context.hierarchy(self.table("documents"), *above, docs, _array(searched), F.array(*(F.lit(c) for c, _, _ in best)).cast("array<long>"), profile.broad)
        sections = materialise(sections, "sections")
        shared = context.corpus_concepts(_array(profile.concepts), documents, sections).first()
        shared = shared.concepts if shared else []
        asked = f"{question}\nterms: {', '.join(searched)}\nconcepts: {', '.join(profile.concepts[:80])}\nbroad: {profile.broad}"

        def about(batches: DataFrame) -> DataFrame:
            return context.batch_contexts(batches, documents, sections, shared)

        got = materialise(self._extract(chunks, docs, asked, about, client, progress, "first reading"), "facts")
        more = [r.query for r in expand.followup_queries(got, _array(searched)).collect()]
        if more:
            progress("extract", message="follow-up")
            profile.terms = spark.range(1).select(normalized(_array([*profile.terms, *more]))).first()[0]
            merged = materialise(expand.guided_merge(self._batched(more, expand.GUIDED_LIMIT, requested)), "guided")
            best = self._merged(best, merged)
            extra = self._extract(expand.focused_chunks(chunks, merged), docs, asked, about, client, progress, "follow-up").withColumn("seq", F.col("seq") + (1 << 60))
            got = materialise(facts.unique_facts(got.unionByName(extra)), "facts")
        progress("synthesize")
        listed = self._reduce(got, question, profile, client)
        audit = None
        if not listed:
            text = NO_EVIDENCE
        else:
            texts = self._fact_texts(listed)
            text = patiently(client, "answer", f"{question}\nbroad: {profile.broad}\n{context.answer_context(documents, sections, shared, profile.broad)}\n{texts}")
            progress("audit")
            text, audit = self._audited(question, text, texts, client, progress)
        progress("answer", total=len(text))
        measured = self._measured(run_id, question, text, audit, profile, listed, [c for c, _, _ in best], not sections.isEmpty())
        return Answer(run_id, text, listed, hits, audit, measured)

    def _merged(self, best: list[tuple[int, int, float]], more: DataFrame) -> list[tuple[int, int, float]]:
        """Hits together with the follow-up's: a chunk in both has the larger score and a step more; the best 48."""
        first = self.spark.createDataFrame([("run", c, d, 0, s) for c, d, s in best], "run_id string, chunk_id long, document_id long, seq long, score double")
        both = first.unionByName(more.select("run_id", "chunk_id", "document_id", F.lit(1).cast("long").alias("seq"), "score"))
        merged = search.diversify(expand.merge_in_order(both, expand.GUIDED_STEP), MERGED_HITS, keys=("run_id",))
        return [(r.chunk_id, r.document_id, r.score) for r in merged.orderBy("rank").collect()]

    def _audited(self, question: str, text: str, texts: str, client: Client, progress: Progress) -> tuple[str, str | None]:
        """The answer, revised once if its audit asks for it, and the audit, or both audits as one."""
        row = self.spark.createDataFrame([(question,)], "q string")
        try:
            audit = patiently(client, "audit", f"{question}\n{text}\n{texts}")
        except Exception:
            return text, None
        if not row.select(evaluate.needs_revision(F.lit(audit))).first()[0]:
            return text, audit
        progress("audit", message="revise")
        try:
            text = patiently(client, "revise", f"{question}\n{text}\n{audit}\n{texts}")
        except Exception:
            return text, audit
        progress("audit", message="again")
        try:
            last = patiently(client, "audit", f"{question}\n{text}\n{texts}")
        except Exception:
            last = None
        return text, row.select(evaluate.combined_audit(F.lit(audit), F.lit(last).cast("string"))).first()[0]

    # --- appended records

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        if rows:
            self.store.append(name, self.spark.createDataFrame(rows, schema).withColumn("at", F.current_timestamp()))

    def _run(self, run_id: str, seq: int, status: str, error: str | None, requested: list[int] | None) -> None:
        """A run's state as a row of its own: the latest one counts."""
        self._append("runs", "run_id string, seq int, status string, mode string, selected_document_ids array<long>, error string", [(run_id, seq, status, self.settings.mode, requested or [], error)])

    def runs(self) -> DataFrame:
        """Each run with its state."""
        return catalog.latest_runs(self.store.log("runs"))

    def log(self, operation: str, status: str, message: str, run_id: str | None, metadata: dict) -> None:
        self._append("logs", "operation string, status string, message string, run_id string, metadata string", [(operation, status, message, run_id, json.dumps(metadata, ensure_ascii=False))])

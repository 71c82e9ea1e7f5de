import importlib
import json
import sys
from importlib.util import find_spec

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import chats, chunking, model
from tessella.plans.pipeline import Cancelled, Corpus, Settings
from tessella.sources.folder import list_files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("store")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("第1章 総則\n（目的）\nこの規程は扶養手当について定める。\n第2条 住居手当は別に定める。\n", encoding="utf-8")
    (tmp_path / "src" / "b.md").write_text("# Guide\n## Use\nCall the API with care.\n")
    return tmp_path


@pytest.fixture(scope="module")
def corpus(spark, folder):
    """One store for all tests here, which run in order."""
    c = Corpus(spark, f"file://{folder}/store")
    c.index_folder(f"{folder}/src")
    return c


class Scripted(model.OfflineClient):
    """Keeps all prompts and answers some kinds from a script."""

    def __init__(self, path, **script):
        self.path, self.script = path, script

    def complete(self, kind, prompt, max_tokens):
        with open(self.path, "a", encoding="utf-8") as f:  # calls come from worker processes as well
            f.write(json.dumps([kind, prompt, max_tokens]) + "\n")
        return self.script[kind] if kind in self.script else super().complete(kind, prompt, max_tokens)

    def prompts(self, kind):
        with open(self.path, encoding="utf-8") as f:
            return [p for k, p, _ in map(json.loads, f) if k == kind]


def test_a_run_that_fails_leaves_the_store_as_it_was(corpus, folder, monkeypatch):
    before, step = corpus.store.read("chunks").collect(), corpus.store.versions()
    (folder / "src" / "b.md").write_text("# Guide\n## Use\nCall the API with care. New words here.\n")
    real = corpus.store.stage_children

    def broken(name, *rest):
        if name == "terms":
            raise OSError("disk gone")
        return real(name, *rest)

    monkeypatch.setattr(corpus.store, "stage_children", broken)
    with pytest.raises(OSError):
        corpus.index_folder(f"{folder}/src")
    assert corpus.store.versions() == step and sorted(corpus.store.read("chunks").collect()) == sorted(before)
    monkeypatch.undo()
    out = corpus.index_folder(f"{folder}/src")
    assert (out["indexed"], out["skipped"]) == (1, 1)
    assert any("New words" in r.content for r in corpus.store.read("chunks").collect())
    assert corpus.store.vacuum() > 0 and corpus.store.read("chunks").count() == out["chunk_count"]


def test_only_touched_buckets_are_written(corpus, folder):
    before = corpus.store.versions()["chunks"]["parts"]
    (folder / "src" / "b.md").write_text("# Guide\nCall the API otherwise.\n")
    corpus.index_folder(f"{folder}/src")
    after = corpus.store.versions()["chunks"]["parts"]
    assert len(before) == 2 and sum(before[k] != after.get(k) for k in before) == 1


def test_two_writers_cant_both_move_the_pointer(corpus, monkeypatch):
    names = corpus.store._pointers()
    entry_ = {"x": corpus.store.stage("x", corpus.spark.range(1))}
    corpus.store.commit(entry_)
    monkeypatch.setattr(corpus.store, "_pointers", lambda: names)
    with pytest.raises(RuntimeError, match="another writer"):
        corpus.store.commit(entry_)


def test_prompts_carry_the_hierarchy_and_whole_facts(corpus, tmp_path):
    audits = json.dumps({"unsupported_claims": ["x"], "verdict": "warning"})
    client = Scripted(tmp_path / "calls", profile=json.dumps({"terms": ["扶養手当の額", 3], "aspects": ["支給条件"], "is_broad": True}), audit=audits)
    got = corpus.answer("扶養手当について", client=client)
    asked = client.prompts("extract")
    assert all("CORPUS concepts:" in p and "DOCUMENT parents:\n- file=" in p for p in asked) and any("SECTION parents:\n- file=a.txt" in p for p in asked)
    assert "扶養手当の額" in asked[0] and "支給条件" in asked[0] and "broad: True" in asked[0]
    final = client.prompts("answer")[0]
    assert "DOCUMENT summaries:" in final and "RELEVANT section summaries:" in final and "polarity: positive" in final and "[F1] file=" in final
    assert len(client.prompts("audit")) == 2 and len(client.prompts("revise")) == 1 and json.loads(got.audit)["revision_applied"]
    assert got.metrics["verdict"] == "warning"


def test_progress_and_records(corpus):
    events = []
    got = corpus.answer("API", on_event=events.append)
    assert all(set(e) == {"stage", "status", "message", "run_id", "completed", "total", "elapsed_ms", "can_cancel"} for e in events)
    assert events == got.stages and events[-1]["status"] == "complete" and not events[-1]["can_cancel"] and events[0]["can_cancel"]
    mine = f"run_id = '{got.run_id}'"
    log = corpus.store.log
    assert corpus.runs().where(mine).first().status == "complete" and log("questions").where(mine).first().text == "API"
    assert log("facts").where(mine).count() == len(got.facts) > 0 and log("answers").where(mine).first().answer == got.answer
    assert log("metrics").where(mine).count() == 1 and log("logs").where("operation = 'index'").count() >= 1


def test_normal_mode_answers_from_hits(spark, corpus, tmp_path):
    client = Scripted(tmp_path / "calls", answer_hits="From [S1].", audit_hits=json.dumps({"unsupported_claims": ["a", "b"], "verdict": "fail"}))
    c = Corpus(spark, corpus.store.root, Settings(mode="normal"))
    got = c.answer("API", client=client)
    assert got.answer == "From [S1]." and got.facts == [] and got.metrics["unsupported_count"] == 2
    assert "[S1] file=b.md" in client.prompts("answer_hits")[0] and "From [S1]." in client.prompts("audit_hits")[0] and not client.prompts("extract")


def test_a_run_can_be_stopped_or_fail(corpus, tmp_path):
    with pytest.raises(ValueError):
        corpus.answer(" ")

    def stop(event):
        if event["stage"] == "extract":
            corpus.tasks.cancel()

    with pytest.raises(Cancelled):
        corpus.answer("API", on_event=stop)

    class Broken(model.OfflineClient):
        def complete(self, kind, prompt, max_tokens):
            if kind == "answer":
                raise ValueError("no answer")
            return super().complete(kind, prompt, max_tokens)

    with pytest.raises(ValueError, match="no answer"):
        corpus.answer("API", client=Broken())
    assert {"cancelled", "failed"} <= {r.status for r in corpus.runs().collect()}


def test_settings_selection_and_items(spark, corpus):
    assert corpus.settings == Settings()
    kept = corpus.save_settings(Settings(context_chars=10, batch_chars=10**9, mode="normal", temperature=7.0))
    assert kept == Settings(3_000, 16_000, "normal", False, 1.0) == Corpus(spark, corpus.store.root).settings
    snapshot = corpus.snapshot()
    assert snapshot["settings"] == kept and snapshot["documents"].count() == 2 and snapshot["stats"]["selected_document_count"] == 2
    corpus.select(1, False)
    assert [r.document_id for r in corpus.documents().collect()] == [2]
    corpus.select(None, False)
    assert corpus.documents().count() == 0
    corpus.select(None, True)
    assert corpus.documents().count() == 2
    assert corpus.chunks_of([chunking.CHUNK_STRIDE]).count() == 1
    assert corpus.evaluation_items().count() == corpus.evaluation_items().count() == 5


def test_backfill_rebuilds_lost_rollups(spark, corpus):
    sections = sorted(map(str, corpus.store.read("sections").collect()))
    nothing = corpus.store.read("contexts").where("document_id <> 1"), spark.createDataFrame([(1,)], "document_id long")
    corpus.store.commit({"contexts": corpus.store.stage_children("contexts", nothing[0].limit(0), nothing[1], corpus.store.touched(nothing[1]))})
    assert corpus.store.read("contexts").count() == 1
    assert corpus.backfill() == 1 and corpus.backfill() == 0
    assert corpus.store.read("contexts").count() == 2 and sorted(map(str, corpus.store.read("sections").collect())) == sections


def test_chats_are_kept_archived_restored_and_deleted(spark):
    rows = [(k % 90, k, f"t{k}") for k in range(180)]
    kept = chats.kept_sessions(spark.createDataFrame(rows, "conv_id long, place long, title string"), "place").withColumn("archived", F.lit(False))
    assert sorted(r.title for r in kept.collect()) == sorted(f"t{k}" for k in range(80))
    gone = chats.archived(kept, 3, True)
    assert chats.deleted(kept, 3).count() == 80 and chats.deleted(gone, 3).count() == 79
    assert [r.archived for r in chats.restored(gone, 3).where("conv_id = 3").collect()] == [False]


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for k in range(9):
        (tmp_path / f"d{k}" / "deep" / "er").mkdir(parents=True)
        (tmp_path / f"d{k}" / "deep" / "er" / ".hid.txt").write_text("x")
        (tmp_path / f"d{k}" / "a.md").write_text("")
        (tmp_path / f"d{k}" / "deep" / "b.png").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "d0")
    want = sorted([str(tmp_path / f"d{k}" / "deep" / "er" / ".hid.txt") for k in range(9)] + [str(tmp_path / f"d{k}" / "a.md") for k in range(9)])
    for folders in (1, 5, 64):
        assert sorted(r.path for r in list_files(spark, str(tmp_path), folders).collect()) == want


def test_only_absent_corpus_operators_are_passed_over(monkeypatch, tmp_path):
    if find_spec("tessella.llm") is None:
        assert entry._llm is None
        return
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    with pytest.raises(ModuleNotFoundError, match="a_library"):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)

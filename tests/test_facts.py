import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import chats, evaluate, facts
from tessella.operators.model import ModelSettings
from tessella.operators.tasks import Tasks

FIELDS = "seq long, chunk_id long, scope string, subject string, object string, condition string, effect string, exception string, polarity string, statement string, quote string, confidence string"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("o")).first().o


BATCH = [(1, 7, "f.txt", "/f", "H", 0, 9), (1, 8, "f.txt", "/f", " ", 9, 19)]


def extracted(spark, *raw):
    replies = spark.createDataFrame([(1, r) for r in raw], "batch_id long, raw string")
    batch = spark.createDataFrame(BATCH, "batch_id long, chunk_id long, file_name string, path string, heading_path string, char_start long, char_end long")
    return facts.facts_from_replies(replies, batch).orderBy("nth").collect()


def test_replies(spark):
    good = {"facts": [{"chunk_id": 7, "statement": " s ", "effect": "支給しない", "confidence": "HIGH"}, {"chunk_id": 8, "object": "o", "condition": "c", "polarity": "odd"}, {"chunk_id": 9, "statement": "elsewhere"}, {"chunk_id": "7", "statement": "text id"}, {"chunk_id": 7}, {"chunk_id": 7, "statement": 5, "subject": "n"}]}
    rows = extracted(spark, "Sure:\n```json\n" + json.dumps(good, ensure_ascii=False) + "\n```")
    assert [(r.chunk_id, r.statement, r.polarity, r.confidence, r.scope) for r in rows] == [(7, "s", "negative", "high", "f.txt / H"), (8, "object=o / condition=c", "conditional", "medium", "f.txt"), (7, "subject=n", "positive", "medium", "f.txt / H")]


@pytest.mark.parametrize("raw", ["nothing", "{broken", '{"other": 1}', "[1]", '{"facts": {}}', None])
def test_replies_without_facts(spark, raw):
    assert extracted(spark, raw) == []


@pytest.mark.parametrize(("raw", "want"), [('{"keep_indexes":[3,1,3]}', [1, 3]), ('x {"keep_indexes":[2]} y', [2]), ('{"keep_indexes":[0]}', None), ('{"keep_indexes":[1,999]}', None), ('{"keep_indexes":["1"]}', None), ('{"keep_indexes":[1.5]}', None), ('{"keep_indexes":[]}', []), ("no", None), ('{"keep_indexes":5}', None)])
def test_kept_indexes(spark, raw, want):
    assert one(spark, raw, facts.keep_indexes("x", F.lit(5))) == want


def fact(seq, **more):
    base = {"chunk_id": 1, "scope": "s", "subject": "a", "object": "b", "condition": "", "effect": "", "exception": "", "polarity": "positive", "statement": f"st{seq}", "quote": "", "confidence": "low"}
    return (seq, *(base | more).values())


def test_only_identity_fields_make_facts_equal(spark):
    rows = [fact(1), fact(2, statement="other", quote="q", confidence="high"), fact(3, exception="e"), fact(4, polarity="negative"), fact(5, subject=" a ")]
    assert {r.seq for r in facts.unique_facts(spark.createDataFrame(rows, FIELDS)).collect()} == {1, 3, 4}


def test_reduction_keeps_what_is_precise_and_the_order(spark):
    rows = [fact(k) for k in range(121)] + [fact(500, condition="c", exception="e", polarity="conditional", confidence="High")]
    got = facts.reduce_facts(spark.createDataFrame(rows, FIELDS), F.array(F.lit("ST7")), F.array().cast("array<string>")).collect()
    assert len(got) == 120 and got[0].seq == 500 and got[0].score == 8.0 and got[1].seq == 7


@pytest.mark.parametrize(("audit", "want"), [('{"verdict":"pass","relationship_errors":[{}]}', True), ('{"verdict":"Warning"}', True), ('{"verdict":"pass","unsupported_claims":[]}', False), ("not json", False), ('{"verdict":"pass","insufficient_evidence_overreach":["x"]}', True), ('{"verdict":5}', False)])
def test_revision(spark, audit, want):
    assert one(spark, audit, evaluate.needs_revision("x")) is want


def test_combined_audits(spark):
    df = spark.createDataFrame([('{"verdict":"pass"}', "no json"), ("bad", None)], "a string, b string")
    x, y = (json.loads(r.o) for r in df.select(evaluate.combined_audit("a", "b").alias("o")).collect())
    assert x == {"revision_applied": True, "initial": {"verdict": "pass"}, "final": {"raw": "no json"}}
    assert y == {"revision_applied": True, "initial": {"raw": "bad"}, "final": {"error": "re-audit failed"}}


def measured(spark, audit, hits=(), facts_=(("alpha", "", ""),), broad=True, answer="says alpha", concepts=("alpha", "beta"), sections=False):
    row = ("r", "which alpha", answer, audit, ["alpha"], list(concepts), broad, [(1, *f) for f in facts_], list(hits), sections)
    df = spark.createDataFrame([row], "run_id string, question string, answer string, audit string, terms array<string>, lower_concepts array<string>, is_broad boolean, facts array<struct<chunk_id:long,object:string,scope:string,statement:string>>, hit_chunks array<long>, has_sections boolean")
    return evaluate.metrics(df).first()


def test_metrics(spark):
    m = measured(spark, '{"verdict":"warning","unsupported_claims":["x"]}')
    assert (m.concept_coverage, m.faithfulness, m.context_recall, m.unsupported_count) == (0.5, 0.53, 0.5, 1)
    m = measured(spark, None, hits=[1], broad=False, sections=True)
    assert (m.verdict, m.faithfulness, m.context_recall) == ("unknown", 0.75, pytest.approx(0.95))
    m = measured(spark, '{"final":{"verdict":"FAIL"},"verdict":"pass"}', facts_=(), answer=None, concepts=())
    assert (m.verdict, m.context_recall, m.concept_coverage, m.answer_relevance) == ("FAIL", 0.0, 0.0, 0.0)


def test_chats(spark):
    turns = [(1, 1, "system", "  be\n\nkind 　 now "), (1, 2, "assistant", "ok"), (1, 3, "user", " "), (2, 1, "assistant", "hi"), (3, 1, "user", "x" * 35), (4, 1, "user", "😀" * 18)]
    got = {r.conv_id: r for r in chats.sessions(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].title == "be kind now" and (got[1].n_messages, got[1].n_user) == (2, 1) and got[2].title == chats.NEW_CHAT
    assert got[3].title == "x" * 34 + "..." and got[4].title == "😀" * 17 + "..."


def test_deltas_and_streams(spark):
    def model(t):
        out, cur = [], ""
        for c in t:
            cur += c
            if len(cur) >= 80 or c == "\n":
                out.append(cur)
                cur = ""
        return out + [cur] if cur else out

    for t in ["", "a\n\nb", "x" * 80 + "\n", "x" * 161, "y" * 79 + "\nz"]:
        assert one(spark, t, chats.deltas("x")) == model(t)
    part = lambda s: "data: " + json.dumps({"choices": [{"delta": {"content": s}}]})
    assert one(spark, "\n\n".join([part("a b"), ": ping", part("c"), "data: [DONE]", part("late")]), chats.sse_text("x")) == "a bc"


def test_request_bodies():
    plain, thinking = ModelSettings().body([], 100), ModelSettings(thinking=True, effort="max").body([], 100, json_mode=True, stream=True)
    assert plain["thinking"]["type"] == "disabled" and "reasoning_effort" not in plain and "response_format" not in plain
    assert thinking["reasoning_effort"] == "max" and thinking["response_format"] == {"type": "json_object"} and thinking["stream"]


def test_a_new_task_takes_the_place_of_the_old(spark):
    tasks = Tasks(spark)
    assert not tasks.cancel()
    with tasks.run("one"):
        assert spark.range(3).count() == 3 and tasks.current
        assert tasks.cancel() and tasks.cancelled()
    assert not tasks.current

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import concepts, text


def model_terms(s):
    out, run, kind = set(), "", 0

    def k(c):
        if c.isascii() and (c.isalnum() or c in "_-"):
            return 1
        o = ord(c)
        return 2 if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0xFF66 <= o <= 0xFF9F else 0

    def close():
        if kind == 1 and 2 <= len(run) <= 40:
            out.add(run.lower())
        if kind == 2:
            if 2 <= len(run) <= 40:
                out.add(run)
            for n in (2, 3):
                out.update(run[i : i + n] for i in range(len(run) - n + 1))

    for c in s + "\0":
        if k(c) != kind:
            close()
            run, kind = "", k(c)
        if k(c):
            run += c
    return sorted(out, key=lambda x: x.encode())


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}") if not isinstance(values[0], tuple) else spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {kind}")
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_terms_as_the_model(spark):
    rng = random.Random(1)
    letters = "abXY09_- .éä扶養手当の々ｱｶﾟＡ한ー\n"
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["a" * 40, "a" * 41, "字" * 41, "x"]
    assert column(spark, values, text.terms("x")) == [model_terms(v) for v in values]


@pytest.mark.parametrize(("value", "want"), [("　a b\t\n", "a b"), ("", ""), (" ", "")])
def test_trim(spark, value, want):
    assert column(spark, [value], text.trim("x")) == [want]


def test_lists_are_trimmed_bounded_and_sorted_by_bytes(spark):
    assert column(spark, [["b", " ab ", "ab", "é1", "Z9", "x" * 81, "字字"]], text.normalized("x"), "array<string>") == [["Z9", "ab", "é1", "字字"]]


def test_snippets_and_bonus(spark):
    body = "x" * 1000 + "needle" + "y" * 1000
    rows = [(body, ["missing", "needle"], "q"), ("short", ["a1"], "q"), (body, ["nothing"], "needle")]
    kind = "content string, terms array<string>, query string"
    a, b, c = column(spark, rows, text.snippet("content", "terms"), kind)
    assert a == "..." + body[1000 - 233 : 1000 - 233 + 700] + "..." and b == "short" and c == body[:700] + "..."
    bonus = column(spark, [("API use 手当", ["api", "use", "手当"], "API")], text.exact_bonus("query", "terms", "content"), kind)
    assert bonus[0] == pytest.approx(0.18 + 0.02 + 0.02)
    assert column(spark, [("abcd" * 9, [f"abcd{'abcd' * k}" for k in range(8)] * 4, "abcd")], text.exact_bonus("query", "terms", "content"), kind)[0] == pytest.approx(0.45)


def test_headings(spark):
    lines = ["第1章 総則", "  （目的） ", "（" + "あ" * 61 + "）", "第一〇条", "第十二条の２ 本文", "text 第1条", "## Title ##", "# C#", "#x", "#######", "```py", "~~"]
    assert column(spark, lines, text.is_regulation_heading("x"))[:6] == [True, True, False, False, True, False]
    got = column(spark, lines, text.markdown_heading("x"))
    assert [(g.level, g.heading) if g else None for g in got[6:10]] == [(2, "Title"), (1, "C#"), None, None]
    assert column(spark, lines, text.is_code_fence("x"))[-2:] == [True, False]
    assert column(spark, ["（目的）第2章", "（目的）", "x"], text.heading_level(F.col("x"))) == [0, 3, 5]


def test_broad_questions(spark):
    rows = [("短い質問", ["a1"]), ("これは十二文字より長い質問です", ["a1"]), ("長い質問文ですが手当を一覧にしてください", []), ("短い", ["x"] * 9)]
    assert column(spark, rows, text.is_broad("q", F.col("t")), "q string, t array<string>") == [True, False, True, False]


SUFFIXES = concepts.SUFFIXES


def model_concepts(s):
    out = []
    for seg in re.findall(concepts.SEGMENT, s):
        for suf in SUFFIXES:
            for at in range(len(seg) - len(suf) + 1):
                if seg.startswith(suf, at):
                    a = max(0, at - 10)
                    while a < at and seg[a] in concepts.CONNECTORS:
                        a += 1
                    for i in range(at - 1, a - 1, -1):
                        if seg[i] in concepts.BOUNDARIES:
                            a = i + 1
                            break
                    c = re.sub(concepts.ARTICLE, "", seg[a:at] + suf)
                    for d in concepts.DETERMINERS:
                        while c.startswith(d):
                            c = c[len(d) :]
                    if 2 <= len(c) <= 18 and c not in text.STOP_TERMS and not re.fullmatch("[第章節条項]+", c):
                        out.append(c)
    return sorted(out)


def test_content_concepts_as_the_model(spark):
    rng = random.Random(4)
    bits = [*SUFFIXES[:6], "扶養", "の", "及び", "当該", "その", "第二条", "者", "住居", "ー", "々", "。", "abc", "時間外"]
    values = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["扶養手当は住居手当及び当該通勤手当の申請"]
    got = column(spark, values, F.array_sort(concepts.content_concepts("x")))
    assert [sorted(g) for g in got] == [model_concepts(v) for v in values]


def test_heading_concepts(spark):
    paths = ["第1章 総則 > （扶養手当） > 第2条　「住居手当」", "", "A > bb >  > cc", "第3条の2 > " + "あ" * 51]
    assert column(spark, paths, concepts.heading_concepts("x"))[:3] == [["住居手当", "扶養手当", "総則"], [], ["bb", "cc"]]


def test_small_functions(spark):
    assert column(spark, ["short", "sk-1234567890"], text.mask_key("x")) == ["configured", "sk-...7890"]
    assert column(spark, [" 12 ", "1.5", "Wed, 21 Oct", "-1", "99999999999999999999"], text.retry_after_ms("x")) == [12000, None, None, None, None]
    assert column(spark, ["Élan-vital_x 3.5", "漢字ab"], text.fts_tokens("x")) == [["elan", "vital", "x", "3", "5"], ["漢字ab"]]

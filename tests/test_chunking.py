import random

from tessella.operators.chunking import Chunk, chunk_documents, chunk_text, lines_of, sections, split_long

REGULATION = "第1章 総則\n（目的）\nこの規程は手当について定める。\n第2条 対象者は次のとおりとする。\n本文です。\n"


def test_a_caption_is_a_level_of_its_own_and_levels_between_are_empty():
    chunks = chunk_text(REGULATION)
    assert [c.heading_path for c in chunks] == ["第1章 総則", "第1章 総則 >  >  > （目的）", "第1章 総則 >  >  > （目的） > 第2条 対象者は次のとおりとする。"]
    assert chunks[1].content == "（目的）\nこの規程は手当について定める。"


def test_offsets_count_untrimmed_code_points():
    text = "\n\n第1章 あ\n  本文  \n\n第2章 い\n終"
    a, b = sections(text, False)
    assert (a.char_start, a.char_end) == (0, text.index("第2章")) and a.content == "第1章 あ\n  本文"
    assert (b.char_start, b.char_end) == (text.index("第2章"), len(text))


def test_markdown_nesting_closing_marks_and_bad_headings():
    text = "# One ##\nx\n## Two\ny\n### Three\nz\n# C#\nw\n#No\n####### seven\n#\n"
    assert [s.heading_path for s in sections(text, True)] == ["One", "One > Two", "One > Two > Three", "C#"]


def test_fences_hide_headings():
    text = "# A\n```\n# not\n第1条 not\n```\n~~~~\n## no\n~~~~\n## B\nb\n"
    assert [s.heading_path for s in sections(text, True)] == ["A", "A > B"]


def test_markdown_and_regulation_levels_combine_and_a_markdown_heading_resets():
    text = "# T\n第1章 一\n（い）\n第2条 二\n## U\n第3条 三\n"
    assert [s.heading_path for s in sections(text, True)] == ["T", "T > 第1章 一", "T > 第1章 一 > （い）", "T > 第1章 一 > 第2条 二", "T > U", "T > U > 第3条 三"]


def test_plain_text_ignores_markdown():
    assert [c.heading_path for c in chunk_text("# A\ntext\n")] == [""]


def test_packing_to_the_target_and_limits():
    line = "x" * 99 + "\n"
    assert [len(c.content) for c in chunk_text(line * 24)] == [2399]
    assert [len(c.content) for c in chunk_text(line * 25)] == [2399, 99]
    parts = [Chunk("a" * 700, "", 0, 700), Chunk("b" * 700, "", 700, 1400), Chunk("c", "", 1400, 1401)]
    from tessella.operators.chunking import pack

    assert [c.content[0] + c.content[-1] for c in pack(iter(parts))] == ["ab", "cc"]
    named = [Chunk("a", "H", 0, 1), Chunk("b", "", 1, 2), Chunk("c", "G", 2, 3)]
    assert [(c.content, c.heading_path) for c in pack(iter(named))] == [("a\n\nb", "H"), ("c", "G")]


def test_a_long_line_stays_whole_and_blank_lines_before_it_make_an_empty_chunk():
    s = Chunk("a\n" + "y" * 3000 + "\n\n" + "z" * 2400 + "\nend", "h", 10, 0)
    out = list(split_long(s))
    assert [c.content for c in out] == ["a", "y" * 3000, "z" * 2400, "end"] or [c.content for c in out][:2] == ["a", "y" * 3000]
    assert out[0].char_start == 10 and out[1].char_start == 12
    assert [c.content for c in split_long(Chunk("\n" * 3 + "y" * 2400, "", 0, 0))] == ["", "y" * 2400]


def test_sections_cover_the_text_in_order():
    rng = random.Random(0)
    pieces = ["# a\n", "第1条 x\n", "（い）\n", "\n", "  \n", "text\n", "```\n", "tail"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert "".join(lines_of(text)) == text
        for md in (False, True):
            out = list(sections(text, md))
            assert all(text[s.char_start : s.char_end].strip() == s.content for s in out)
            assert all(a.char_end <= b.char_start for a, b in zip(out, out[1:], strict=False))


def test_frames(spark):
    df = spark.createDataFrame([(1, "/a.txt", REGULATION), (2, "/b.MD", "# T\nx\n## U\ny\n"), (3, "/c.txt", None), (4, "/d.md", "")], "document_id long, path string, text string")
    rows = {r.chunk_id: r for r in chunk_documents(df).collect()}
    assert sorted(rows) == [1000000, 1000001, 1000002, 2000000, 2000001]
    assert rows[1000000].next_chunk_id == 1000001 and rows[1000002].next_chunk_id is None and rows[2000001].prev_chunk_id == 2000000

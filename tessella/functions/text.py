"""Text functions as Column expressions: terms, weights, bonuses, snippets, headings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, caps and word lists that results depend on.
ASCII_RUN = "[A-Za-z0-9_-]+"
WIDE_RUN = "[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f]+"
TERM_MIN, TERM_MAX = 2, 40
LIST_MIN, LIST_MAX = 2, 80
STOP_TERMS = ["どう", "なっ", "なって", "います", "ます", "です", "ください", "教えて", "について", "もの", "こと", "場合", "情報", "質問", "回答", "一覧", "まとめ", "全体", "全部", "全て", "すべて"]
BROAD_MARKERS = ["どうなっていますか", "どうなってますか", "全体", "一覧", "まとめ", "網羅", "すべて", "全部", "全て", "教えて", "について"]
REGULATION = r"^\s*(第[0-9０-９一二三四五六七八九十百千]+(章|節|款|目|条).*)\s*$"
CAPTION = r"^\s*（[^）]{1,60}）\s*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Without Unicode white space at either end; Spark's own trim knows only U+0020."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def _between(x: Column, low: int, high: int) -> Column:
    return F.length(x).between(low, high)


def _grams(run: Column, n: int) -> Column:
    places = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(run, i, F.lit(n)))


def terms(text: Column | str, ordered: bool = True) -> Column:
    """Distinct terms: ASCII words in lower case; runs of wide scripts with their 2- and 3-grams. In byte order."""
    text = col(text)
    words = F.filter(F.transform(F.regexp_extract_all(text, F.lit(ASCII_RUN), F.lit(0)), F.lower), lambda x: _between(x, TERM_MIN, TERM_MAX))
    runs = F.regexp_extract_all(text, F.lit(WIDE_RUN), F.lit(0))
    wide = F.flatten(F.transform(runs, lambda r: F.concat(F.filter(F.array(r), lambda x: _between(x, TERM_MIN, TERM_MAX)), _grams(r, 2), _grams(r, 3))))
    found = F.array_distinct(F.concat(words, F.when(text.rlike(WIDE_RUN), wide).otherwise(F.array().cast("array<string>"))))
    return F.array_sort(found) if ordered else found


def term_weight(term: Column) -> Column:
    return F.when(F.length(term) >= 4, 2.0).otherwise(1.0)


def normalized(items: Column | str) -> Column:
    """Trimmed, 2 to 80 characters, distinct, in byte order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(col(items), trim), lambda x: _between(x, LIST_MIN, LIST_MAX))))


def first_chars(text: Column | str, n: int) -> Column:
    text = col(text)
    return F.translate(F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise("")), "\n", " ")


def truncated(text: Column | str, n: int) -> Column:
    """first_chars for logs: line ends stay."""
    text = col(text)
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def is_stop(term: Column) -> Column:
    return term.isin(STOP_TERMS)


def meaningful_terms(question: Column | str, given: Column) -> Column:
    found = F.concat(given, terms(question))
    return normalized(F.filter(found, lambda x: (F.length(x) >= 2) & ~is_stop(x)))


def matches_any(concept: Column, wanted: Column) -> Column:
    """Whether a term holds the concept or is held by it."""
    return F.exists(wanted, lambda t: (F.length(t) >= 2) & (F.contains(concept, t) | F.contains(t, concept)))


def is_broad(question: Column | str, given: Column) -> Column:
    q = trim(question)
    marked = F.lit(False)
    for m in BROAD_MARKERS:
        marked = marked | F.contains(q, F.lit(m))
    return ((F.length(q) <= 12) & (F.size(given) <= 8)) | marked


def exact_bonus(query: Column | str, wanted: Column | str, text: Column | str) -> Column:
    """What literal, case-sensitive occurrences of the query and its first 30 terms are worth, up to 0.45."""
    q, text = trim(query), col(text)
    each = F.transform(F.slice(col(wanted), 1, 30), lambda t: F.when((F.length(t) >= 2) & F.contains(text, t), F.when(F.length(t) >= 4, 0.045).otherwise(0.02)).otherwise(0.0))
    whole = F.when((F.length(q) > 0) & F.contains(text, q), 0.18).otherwise(0.0)
    return F.least(F.lit(0.45), whole + F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def snippet(content: Column | str, wanted: Column | str, n: int = 700) -> Column:
    """The text around the first listed term that occurs, n characters, with dots where it is cut."""
    content = col(content)
    at = F.filter(F.transform(F.filter(col(wanted), lambda t: F.length(t) >= 2), lambda t: F.instr(content, t)), lambda p: p > 0)
    hit = F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(1)) - 1
    start = F.greatest(hit - n // 3, F.lit(0))
    end = F.least(start + n, F.length(content))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(content, start + 1, end - start), F.when(end < F.length(content), "...").otherwise(""))
    return F.when(F.length(content) <= n, content).otherwise(cut)


def heading_level(line: Column) -> Column:
    level = F.lit(5)
    for k, mark in reversed(list(enumerate("章節款目条"))):
        level = F.when(F.contains(line, F.lit(mark)), k).otherwise(level)
    return level


def is_regulation_heading(line: Column | str) -> Column:
    return trim(line).rlike(REGULATION) | trim(line).rlike(CAPTION)


def is_code_fence(line: Column | str) -> Column:
    return trim(line).rlike("^(```|~~~)")


def markdown_heading(line: Column | str) -> Column:
    """struct(level, heading), null if the line is no heading."""
    line = trim(line)
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})(?=(?U:\s)|$)", 1))
    rest = trim(F.regexp_replace(line, "^#+", ""))
    heading = F.regexp_replace(rest, r"(?U)\s+#+$", "")
    return F.when((marks > 0) & (F.length(heading) > 0), F.struct(marks.alias("level"), heading.alias("heading")))


def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is a base letter with marks, and the base letters in lower case."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs.append((c, base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folding()


def fts_tokens(text: Column | str) -> Column:
    """Tokens of the full-text index: runs of letters and digits, lower case, without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(F.translate(col(text), _MARKED, _PLAIN)), _MARKED, _PLAIN), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mask_key(key: Column | str) -> Column:
    key = trim(key)
    return F.when(F.length(key) <= 8, "configured").otherwise(F.concat(F.substring(key, 1, 3), F.lit("..."), F.substring(key, -4, 4)))


def retry_after_ms(raw: Column | str) -> Column:
    """Whole seconds as milliseconds; anything else is null."""
    raw = trim(raw)
    return F.when(raw.rlike(r"^\+?\d+$"), F.regexp_replace(raw, r"^\+", "").try_cast("bigint") * 1000)


def failure_class(status: Column, message: Column) -> Column:
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limit")
        .when((status == 400) & F.contains(F.lower(message), F.lit("context")), "context_limit")
        .when(status == 413, "context_limit")
        .when(status.between(500, 599), "server")
        .otherwise("api_error")
    )

"""Concepts: names in headings, and compound nouns of regulations in running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import _between, col, is_stop, normalized, trim

# The nouns that end a concept, what may not begin or cross one, and names too general to be one.
SUFFIXES = ["手当", "休暇", "休業", "規程", "規則", "制度", "給与", "勤務", "旅費", "届出", "申請", "許可", "承認", "控除", "賞与", "退職", "手続", "補助", "扶養"]
CONNECTORS = "のにをはがと及び又"
BOUNDARIES = "のにをはがと及び又者時合"
DETERMINERS = ["この", "その", "当該", "各", "別に定める"]
GENERIC = ["総則", "目的", "定義", "適用範囲", "雑則", "附則", "施行", "改正", "経過措置"]
ARTICLE = "^第[0-9０-９一二三四五六七八九十百千]+(章|節|款|目|条)"
SEGMENT = "[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff々ー]+"
REACH = 10


def heading_concepts(path: Column | str) -> Column:
    """Distinct concepts of a heading path, without captions' brackets, article numbers and quotes."""

    def clean(raw: Column) -> Column:
        x = trim(raw)
        caption = x.startswith("（") & x.endswith("）") & (F.length(x) <= 60)
        x = F.when(caption, trim(F.regexp_replace(x, "^（+|）+$", ""))).otherwise(x)
        return F.regexp_replace(trim(F.regexp_replace(x, ARTICLE + r"(?U:\s*)", "")), "^[「」\"' \t]+|[「」\"' \t]+$", "")

    return normalized(F.filter(F.transform(F.split(col(path), " > "), clean), lambda x: _between(x, 2, 50)))


def content_concepts(text: Column | str) -> Column:
    """Every occurrence of a concept in a text, as an array with repeats.

    Each place of a suffix noun counts. A concept reaches back from it over at most ten characters,
    drops connectors it would begin with, and doesn't cross a boundary character.
    """

    def at(segment: Column, suffix: Column) -> Column:
        last = F.length(segment) - F.length(suffix) + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        places = F.filter(places, lambda i: F.substring(segment, i, F.length(suffix)) == suffix)

        def back(i: Column) -> Column:
            low = F.greatest(i - REACH, F.lit(1))
            before = F.regexp_replace(F.substring(segment, low, i - low), f"^[{CONNECTORS}]+", "")
            return F.concat(F.regexp_replace(before, f"^.*[{BOUNDARIES}]", ""), suffix)

        return F.transform(places, back)

    def clean(raw: Column) -> Column:
        x = trim(F.regexp_replace(trim(raw), ARTICLE, ""))
        for d in DETERMINERS:
            x = F.regexp_replace(x, f"^({d})+", "")
        return x

    segments = F.regexp_extract_all(col(text), F.lit(SEGMENT), F.lit(0))
    found = F.flatten(F.transform(segments, lambda s: F.flatten(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda x: at(s, x)))))
    kept = F.filter(F.transform(found, clean), lambda x: _between(x, 2, 18) & ~is_stop(x) & ~x.rlike("^[第章節条項]+$"))
    return F.when(col(text).rlike("|".join(SUFFIXES)), kept).otherwise(F.array().cast("array<string>"))


def concept_scores(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, concept, score): 3 for each chunk whose heading has the concept, 1 for each occurrence in the text."""
    headed = chunks.select(*keys, F.explode(heading_concepts("heading_path")).alias("concept"), F.lit(3.0).alias("w"))
    written = chunks.select(*keys, F.explode(content_concepts("content")).alias("concept"), F.lit(1.0).alias("w"))
    return headed.unionByName(written).where(~F.col("concept").isin(GENERIC)).groupBy(*keys, "concept").agg(F.sum("w").alias("score"))


def top_concepts(chunks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, concepts): the k best by score, ties by name, then in byte order."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "concept"))
    best = concept_scores(chunks, keys).withColumn("nth", nth).where(F.col("nth") <= k)
    return best.groupBy(*keys).agg(normalized(F.collect_list("concept")).alias("concepts"))

"""Facts from model replies: parsing and repair, normal forms, de-duplication, reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import col, trim

# Fixed values
TEXT_FIELDS = ["statement", "scope", "subject", "object", "condition", "effect", "exception", "polarity", "quote", "confidence"]
IDENTITY = ["scope", "subject", "object", "condition", "effect", "exception", "polarity"]
NEGATIVE_MARKS = ["ない", "対象外", "除く", "禁止"]
KEPT_FACTS = 120
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column | str) -> Column:
    return F.translate(col(x), _UPPER, _LOWER)


def candidate(raw: Column | str) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(col(raw), r"(?s)\{.*\}", 0), F.lit(""))


def object_of(raw: Column | str) -> Column:
    """A reply as a variant: the whole of it, else the braces in it; null if neither is JSON."""
    return F.coalesce(F.try_parse_json(col(raw)), F.try_parse_json(candidate(raw)))


def _text(item: Column, name: str) -> Column:
    """A string field, trimmed; anything but a string is empty."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    return trim(F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string")), F.lit("")))


def polarity(raw: Column, condition: Column, effect: Column) -> Column:
    value = ascii_lower(trim(raw))
    negative = F.lit(False)
    for m in NEGATIVE_MARKS:
        negative = negative | F.contains(effect, F.lit(m))
    return F.when(value.isin("positive", "negative", "conditional"), value).when(F.length(trim(condition)) > 0, "conditional").when(negative, "negative").otherwise("positive")


def confidence(raw: Column) -> Column:
    value = ascii_lower(trim(raw))
    return F.when(value.isin("high", "medium", "low"), value).otherwise("medium")


def composed(fields: tuple[str, ...] = ("subject", "object", "condition", "effect", "exception")) -> Column:
    """key=value of the fields that aren't blank."""
    return F.concat_ws(" / ", *(F.when(F.length(trim(f)) > 0, F.concat(F.lit(f"{f}="), trim(f))) for f in fields))


def has_facts(raw: Column | str) -> Column:
    """Whether a reply holds an array of facts."""
    return F.try_variant_get(object_of(raw), "$.facts", "array<variant>").isNotNull()


def facts_from_replies(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts of replies (batch_id, raw) whose chunk is in the batch (batch_id, chunk_id, file_name, path, heading_path, char_start, char_end).

    A reply that isn't JSON, or has no array of facts, gives none. A fact without a statement gets
    one from its fields; without these it is dropped.
    """
    parsed = replies.select("batch_id", F.try_variant_get(object_of("raw"), "$.facts", "array<variant>").alias("facts"))
    items = parsed.select("batch_id", F.posexplode("facts").alias("nth", "item"))
    number = F.try_variant_get("item", "$.chunk_id", "variant")
    whole = F.when(F.schema_of_variant(number).rlike("INT|LONG|SHORT|BYTE"), F.try_variant_get("item", "$.chunk_id", "bigint"))
    rows = items.select("batch_id", "nth", F.coalesce(whole, F.lit(0)).alias("chunk_id"), *(_text(F.col("item"), f).alias(f) for f in TEXT_FIELDS))
    rows = rows.withColumn("polarity", polarity(F.col("polarity"), F.col("condition"), F.col("effect"))).withColumn("confidence", confidence(F.col("confidence")))
    rows = rows.withColumn("statement", F.when(F.length("statement") > 0, F.col("statement")).otherwise(composed())).where("statement <> ''")
    out = rows.join(chunks, ["batch_id", "chunk_id"])
    blank = F.length(trim("heading_path")) == 0
    scope = F.when(blank, F.col("file_name")).otherwise(F.concat("file_name", F.lit(" / "), "heading_path"))
    return out.withColumn("scope", F.when(F.length("scope") > 0, F.col("scope")).otherwise(scope))


def unique_facts(facts: DataFrame, order: str = "seq") -> DataFrame:
    """The first of each chunk, scope, subject, object, condition, effect, exception and polarity."""
    nth = F.row_number().over(W.partitionBy("chunk_id", *(trim(c) for c in IDENTITY)).orderBy(order))
    return facts.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def keep_indexes(raw: Column | str, n: Column) -> Column:
    """Distinct indexes of a reply in order; null unless all are whole numbers from 1 to n."""
    items = F.try_variant_get(object_of(raw), "$.keep_indexes", "array<variant>")
    sound = F.forall(items, lambda v: F.schema_of_variant(v).rlike("INT|LONG|SHORT|BYTE") & F.coalesce(F.try_variant_get(v, "$", "bigint").between(1, n), F.lit(False)))
    return F.when(sound, F.array_sort(F.array_distinct(F.transform(items, lambda v: F.try_variant_get(v, "$", "bigint")))))


def fact_score(wanted: Column, concepts: Column) -> Column:
    """Points for terms and concepts that a fact has, and for what makes it precise."""
    text = F.concat_ws(" ", *("scope subject object condition effect exception statement quote".split()))
    has = lambda t: F.contains(text, t) | F.contains(ascii_lower(text), ascii_lower(t))
    some = lambda c: F.length(trim(c)) > 0
    level = ascii_lower(trim("confidence"))
    return F.round(
        F.size(F.filter(wanted, has)) * 2.0
        + F.size(F.filter(concepts, has)) * 3.0
        + F.when(level == "high", 2.0).when(level == "medium", 1.0).otherwise(0.0)
        + F.when(some("exception"), 2.5).otherwise(0.0)
        + F.when(ascii_lower(trim("polarity")).isin("negative", "conditional"), 2.0).otherwise(0.0)
        + F.when(some("condition"), 1.5).otherwise(0.0)
        + F.when(some("quote"), 0.8).otherwise(0.0),
        6,
    )


def reduce_facts(facts: DataFrame, wanted: Column, concepts: Column, keep: int = KEPT_FACTS) -> DataFrame:
    """The best facts by score, earlier ones first among equals."""
    return facts.withColumn("score", fact_score(wanted, concepts)).orderBy(F.desc("score"), "seq").limit(keep)


def fact_text() -> Column:
    """A fact as a prompt shows it; needs index."""
    names = ["scope", "subject", "object", "condition", "effect", "exception", "polarity", "confidence", "statement", "quote"]
    return F.format_string("[F%d] file=%s chunk=%d chars=%d-%d heading=%s\n" + "".join(f"{n}: %s\n" for n in names) + "\n", "index", "file_name", "chunk_id", "char_start", "char_end", "heading_path", *names)

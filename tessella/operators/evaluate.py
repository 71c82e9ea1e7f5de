"""Audits and evaluation metrics of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import clamp01, col, meaningful_terms, normalized, ratio, trim
from tessella.operators.facts import ascii_lower

# Fixed values
COUNTED = {"unsupported_claims": "unsupported_count", "relationship_errors": "relationship_error_count", "scope_errors": "scope_error_count", "polarity_errors": "polarity_error_count"}
REVISED_FOR = [*COUNTED, "insufficient_evidence_overreach"]


def _size(json: Column, name: str) -> Column:
    return F.coalesce(F.size(F.try_variant_get(json, f"$.{name}", "array<variant>")), F.lit(0))


def _string(json: Column, name: str) -> Column:
    value = F.try_variant_get(json, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(json, f"$.{name}", "string"))


def needs_revision(audit: Column | str) -> Column:
    """A verdict of warning or fail, or any finding; an audit that isn't JSON asks for nothing."""
    json = F.try_parse_json(col(audit))
    found = ascii_lower(F.coalesce(_string(json, "verdict"), F.lit(""))).isin("warning", "fail")
    for name in REVISED_FOR:
        found = found | (F.greatest(_size(json, name), F.lit(0)) > 0)
    return F.coalesce(found, F.lit(False))


def combined_audit(first: Column | str, last: Column | str) -> Column:
    """Both audits as one JSON text; what isn't JSON stands under raw, and a missing last one is an error."""
    wrapped = lambda c: F.when(F.try_parse_json(col(c)).isNotNull(), col(c)).otherwise(F.to_json(F.struct(col(c).alias("raw"))))
    end = F.when(col(last).isNull(), '{"error":"re-audit failed"}').otherwise(wrapped(last))
    return F.concat(F.lit('{"final":'), end, F.lit(',"initial":'), wrapped(first), F.lit(',"revision_applied":true}'))


def audit_counts(audit: Column | str) -> list[Column]:
    """Four counts and the verdict, of the final audit if there are two."""
    json = F.try_parse_json(col(audit))
    source = F.coalesce(F.try_variant_get(json, "$.final", "variant"), json)
    counts = [F.greatest(_size(source, k), F.lit(0)).alias(v) for k, v in COUNTED.items()]
    return [*counts, F.coalesce(_string(source, "verdict"), F.lit("unknown")).alias("verdict")]


def faithfulness() -> Column:
    base = F.when(F.col("verdict") == "pass", 1.0).when(F.col("verdict") == "warning", 0.65).when(F.col("verdict") == "fail", 0.25).otherwise(0.75)
    return clamp01(base - F.col("unsupported_count") * 0.12 - (F.col("relationship_error_count") + F.col("scope_error_count") + F.col("polarity_error_count")) * 0.14)


def metrics(runs: DataFrame) -> DataFrame:
    """Metrics of runs: run_id, question, answer, audit, terms, lower_concepts, is_broad, facts (array of struct with chunk_id, object, scope, statement), hit_chunks, has_sections."""
    rows = runs.select("*", *audit_counts("audit"))
    answer, facts = F.coalesce("answer", F.lit("")), F.col("facts")
    covered = F.filter("lower_concepts", lambda c: F.contains(answer, c) | F.exists(facts, lambda f: F.contains(f.getField("object"), c) | F.contains(f.getField("scope"), c) | F.contains(f.getField("statement"), c)))
    coverage = F.when(F.size("lower_concepts") == 0, F.when(F.size("facts") == 0, 0.0).otherwise(1.0)).otherwise(ratio(F.size(covered), F.size("lower_concepts")))
    rows = rows.withColumn("concept_coverage", coverage)
    chunks = F.array_distinct(facts.getField("chunk_id"))
    overlap = F.when(F.size("hit_chunks") == 0, 0.5).otherwise(ratio(F.size(F.array_intersect(chunks, "hit_chunks")), F.size(chunks)))
    recall = clamp01(overlap * 0.45 + F.when(F.col("is_broad"), F.col("concept_coverage") * 0.55).otherwise(0.35) + F.when(F.col("has_sections"), 0.15).otherwise(0.0))
    rows = rows.withColumn("context_recall", F.when(F.size("facts") == 0, 0.0).otherwise(recall)).withColumn("faithfulness", faithfulness())
    wanted = normalized(F.concat(meaningful_terms("question", F.concat("terms", "lower_concepts")), F.slice("lower_concepts", 1, 20)))
    some = F.length(trim(answer)) > 0
    hit = ratio(F.size(F.filter(wanted, lambda t: F.contains(answer, t))), F.size(wanted)) * 0.8 + F.when(some, 0.2).otherwise(0.0)
    rows = rows.withColumn("answer_relevance", F.when(F.size(wanted) == 0, F.when(some, 1.0).otherwise(0.0)).otherwise(clamp01(hit)))
    return rows.select("run_id", *(F.round(c, 6).alias(c) for c in ("context_recall", "faithfulness", "answer_relevance", "concept_coverage")), *(F.col(c).cast("int").alias(c) for c in COUNTED.values()), "verdict")

"""The boundary to a language model: a client protocol, an offline stand-in, and calls from tasks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values
MAX_CONCURRENT, BACK_OFF, RETRIES, LONGEST_WAIT_S = 5, (5, 3, 1), 2, 15
TOKENS = {"profile": 800, "extract": 1400, "reduce": 1200, "repair_facts": 1400, "repair_indexes": 700, "answer": 3500, "revise": 3000, "audit": 1500, "answer_hits": 2000, "audit_hits": 1000}


class RateLimited(Exception):
    def __init__(self, retry_after_s: int | None = None):
        super().__init__("rate limit")
        self.retry_after_s = retry_after_s


class Client(Protocol):
    """One reply for a task's kind and prompt. Raises RateLimited to be asked again."""

    def complete(self, kind: str, prompt: str, max_tokens: int) -> str: ...


@dataclass
class ModelSettings:
    """What a chat request carries besides its messages."""

    model: str = "offline"
    temperature: float = 0.0
    thinking: bool = False
    effort: str = "high"

    def body(self, messages: list[dict], max_tokens: int, json_mode: bool = False, stream: bool = False) -> dict:
        """A chat request. An effort is sent only with thinking, a response format only for JSON."""
        optional = {"reasoning_effort": self.effort if self.thinking else None, "response_format": {"type": "json_object"} if json_mode else None}
        fixed = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": max_tokens, "stream": stream, "thinking": {"type": "enabled" if self.thinking else "disabled"}}
        return fixed | {k: v for k, v in optional.items() if v is not None}


@dataclass
class OfflineClient:
    """A deterministic stand-in for tests and machines without a network. It is no language model.

    It makes a fact of each chunk's first sentence, keeps everything, answers with the facts and
    finds nothing to object to.
    """

    def complete(self, kind: str, prompt: str, max_tokens: int) -> str:
        if kind == "extract":
            found = []
            for block in prompt.split("<<chunk ")[1:]:
                number, _, text = block.partition(">>\n")
                first = text.strip().split("。")[0].split(".")[0].strip()[:200]
                if first:
                    found.append({"chunk_id": int(number), "statement": first, "object": first[:40], "quote": first, "confidence": "medium"})
            return json.dumps({"facts": found}, ensure_ascii=False)
        if kind == "profile":
            return json.dumps({"terms": [], "aspects": [], "is_broad": False})
        if kind in ("audit", "audit_hits"):
            return json.dumps({"unsupported_claims": [], "relationship_errors": [], "scope_errors": [], "polarity_errors": [], "insufficient_evidence_overreach": [], "verdict": "pass"})
        if kind == "reduce":
            return json.dumps({"keep_indexes": []})
        return "\n".join(line for line in prompt.splitlines() if line.startswith(("[F", "statement:")))


def patiently(client: Client, kind: str, prompt: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """A reply after at most two waits, and none longer than 15 seconds."""
    for left in range(RETRIES, -1, -1):
        try:
            return client.complete(kind, prompt, TOKENS.get(kind, 1000))
        except RateLimited as e:
            if not left or e.retry_after_s is None or e.retry_after_s > LONGEST_WAIT_S:
                raise
            sleep(e.retry_after_s)
    raise AssertionError


def ask(prompts: DataFrame, kind: str, client: Client, concurrent: int = MAX_CONCURRENT) -> DataFrame:
    """(batch_id, raw, error) for (batch_id, prompt): at most `concurrent` calls at a time, a failed one in its own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raws, errors = b.column("batch_id").to_pylist(), [], []
            for prompt in b.column("prompt").to_pylist():
                try:
                    raws.append(patiently(client, kind, prompt))
                    errors.append(None)
                except Exception as e:
                    raws.append(None)
                    errors.append("rate_limit" if isinstance(e, RateLimited) else str(e))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.string()), pa.array(errors, pa.string())], names=["batch_id", "raw", "error"])

    return prompts.select(F.col("batch_id").cast("long"), "prompt").repartition(concurrent).mapInArrow(run, "batch_id long, raw string, error string")


def ask_in_waves(prompts: DataFrame, kind: str, client: Client, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ask with fewer and fewer calls at a time, 5, 3 and 1, for those that met a rate limit. save stores a wave's replies."""
    out, left = None, prompts
    for n in BACK_OFF:
        replies = save(ask(left, kind, client, n))
        done = replies.where("error IS NULL OR error <> 'rate_limit'")
        out = done if out is None else out.unionByName(done)
        limited = replies.where("error = 'rate_limit'").select("batch_id")
        if limited.isEmpty():
            return out
        left = left.join(limited, "batch_id", "left_semi")
    return out.unionByName(limited.select("batch_id", F.lit(None).cast("string").alias("raw"), F.lit("rate_limit").alias("error")))

"""Shared plumbing of the corpus operators: tables, scratch tables that outlive an executor, small batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.scratch import discard, materialise, scratch_path

__all__ = ["discard", "materialise", "scratch_path", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: a worker then holds little besides what Spark has sent."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)

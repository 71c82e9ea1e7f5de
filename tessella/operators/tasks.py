"""One running task at a time, and its cancellation by job tag."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Tasks:
    """A slot for the current task. Starting another one replaces it; cancelling interrupts its Spark jobs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.current, self._stopped = spark, None, set()

    @contextmanager
    def run(self, name: str) -> Iterator[str]:
        tag = f"{name}-{uuid.uuid4().hex}"
        self.current = tag
        self.spark.addTag(tag)
        try:
            yield tag
        finally:
            self.spark.removeTag(tag)
            if self.current == tag:
                self.current = None

    def cancel(self) -> bool:
        """Stops the current task's jobs; whether there was one."""
        if self.current is None:
            return False
        self._stopped.add(self.current)
        self.spark.interruptTag(self.current)
        return True

    def cancelled(self, tag: str | None = None) -> bool:
        return (tag or self.current) in self._stopped

"""Ordered, batched consumption of a finite relation, with memory bounded by the batch and one partition."""

from __future__ import annotations

import queue
import threading
import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql.types import StructType

DEFAULT_BATCH = 4096


class Reader:
    """Pull reader over a DataFrame: rows come in partition order.

    `read(n)` returns up to n rows and an empty list at the end; `batches(n)` iterates; `channel(n)`
    produces in the background, two batches ahead. `close()` cancels the Spark jobs that still run.
    """

    def __init__(self, df: DataFrame, prefetch: bool = False) -> None:
        self.df, self.prefetch = df, prefetch
        self._group = f"rowsmith-{uuid.uuid4().hex}"
        self._rows: Iterator[Row] | None = None
        self._stop = threading.Event()
        self._error: BaseException | None = None
        self._thread: threading.Thread | None = None

    @property
    def schema(self) -> StructType:
        return self.df.schema

    def num_rows(self) -> int:
        return self.df.count()

    def _iterate(self) -> Iterator[Row]:
        if self._stop.is_set():
            raise ValueError("the reader is closed")
        if self._rows is None:
            self.df.sparkSession.sparkContext.setJobGroup(self._group, "rowsmith reader", interruptOnCancel=True)
            self._rows = self.df.toLocalIterator(prefetchPartitions=self.prefetch)
        return self._rows

    def read(self, n: int = DEFAULT_BATCH) -> list[Row]:
        return list(islice(self._iterate(), max(1, n)))

    def batches(self, n: int = DEFAULT_BATCH) -> Iterator[list[Row]]:
        while batch := self.read(n):
            yield batch

    def channel(self, n: int = DEFAULT_BATCH, ahead: int = 2) -> Iterator[list[Row]]:
        """Batches made by a background thread; an error in it is raised here."""
        out: queue.Queue = queue.Queue(maxsize=max(1, ahead))

        def put(item) -> bool:
            while not self._stop.is_set():
                try:
                    out.put(item, timeout=0.1)
                    return True
                except queue.Full:
                    continue
            return False

        def produce() -> None:
            try:
                for batch in self.batches(n):
                    if not put(batch):
                        return
            except BaseException as e:  # noqa: BLE001  handed to the consumer
                self._error = e
            put(None)

        self._thread = threading.Thread(target=produce, daemon=True)
        self._thread.start()
        try:
            while (batch := out.get()) is not None:
                yield batch
            if self._error:
                raise self._error
        finally:
            if self._thread.is_alive():
                self.close()

    def close(self) -> None:
        if not self._stop.is_set():
            self._stop.set()
            self.df.sparkSession.sparkContext.cancelJobGroup(self._group)
            self._rows = None

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_reader(df: DataFrame, prefetch: bool = False) -> Reader:
    return Reader(df, prefetch)

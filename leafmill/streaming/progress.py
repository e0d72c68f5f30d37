"""Totals of a running job: what has been done of all there is, told as its batches end."""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent


class JobProgress(StreamingQueryListener):
    """[A12, X32] The shares of a streamed job whose rows are counted by ``counted``: after each batch (done of total), from 0 to 1.

    ``work`` of a row may be anything that adds up: 1 for documents, characters for speech. Shares never fall; a batch that is run again
    after a failure counts once, by its number. ``tell`` is called with each share, on the listener's thread. Where ``total`` is 0 the share is 1.
    """

    def __init__(self, name: str, total: float, tell: Callable[[float], None] | None = None):
        self.name, self.total, self.tell = name, total, tell
        self.batches: dict[int, float] = {}
        self.shares: list[float] = []
        self._lock = Lock()

    def counted(self, rows: DataFrame, work: Column | None = None) -> DataFrame:
        """``rows``, unchanged, whose work is added up as they pass."""
        return rows.observe(self.name, F.sum(F.lit(1) if work is None else work).cast("double").alias("work"))

    @property
    def done(self) -> float:
        return sum(self.batches.values())

    def onQueryStarted(self, event: QueryStartedEvent) -> None: ...

    def onQueryIdle(self, event: QueryIdleEvent) -> None: ...

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None: ...

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        with self._lock:
            self.batches[event.progress.batchId] = found["work"] or 0.0
            share = min(1.0, self.done / self.total) if self.total else 1.0
            self.shares.append(max([share, *self.shares[-1:]]))
        if self.tell:
            self.tell(self.shares[-1])


def counted_write(rows: DataFrame, write: Callable[[DataFrame], None], work: Column) -> float:
    """[A12] The work of all rows that a batch job has written: added up in the job itself, so nothing is read twice."""
    seen = Observation()
    write(rows.observe(seen, F.sum(work).cast("double").alias("work")))
    return seen.get["work"] or 0.0

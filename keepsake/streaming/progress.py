"""Counts that come with a run and not by a second pass: observed batch plans and streams."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(**conditions: Column) -> list[Column]:
    """Aggregates: all rows as ``total``, and those for which each condition holds."""
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()]]


def observed(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The rows, and what will hold their counts once they have been written or collected: ``observation.get``.

    The counts are taken while the rows go by; a task that is run again counts once.
    """
    observation = Observation()
    return rows.observe(observation, *counted(**conditions)), observation


class Progress(StreamingQueryListener):
    """The counts of streams that were given a name by ``watched``, added up over their batches.

    Add it to ``spark.streams`` before they start; a batch that is run again after a failure counts again,
    since its rows do go by again.
    """

    def __init__(self) -> None:
        self._counts: dict[str, Counter] = {}
        self._lock = Lock()

    def counts(self, name: str) -> dict[str, int]:
        with self._lock:
            return dict(self._counts.get(name, {}))

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                self._counts.setdefault(name, Counter()).update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def watched(stream: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """A stream whose batches tell their counts under ``name``."""
    return stream.observe(name, *counted(**conditions))

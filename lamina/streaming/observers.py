"""Hooks on what runs: progress and completion of streams, and counts taken on the way through a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class Callbacks(StreamingQueryListener):
    """Calls ``progress(name, batch, rows)`` after each micro-batch and ``done(name, error)`` at the end of a stream.

    A hook that fails doesn't stop the stream; its error is kept in ``errors``.
    """

    def __init__(self, progress: Callable[[str, int, int], None] | None = None, done: Callable[[str, str | None], None] | None = None):
        self.progress, self.done, self.names, self.errors = progress, done, {}, []

    def _call(self, hook: Callable | None, *values) -> None:
        if hook is None:
            return
        try:
            hook(*values)
        except Exception as error:  # a hook must not end what it watches
            self.errors.append(error)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._call(self.progress, p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._call(self.done, self.names.get(str(event.id), str(event.id)), event.exception)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with named aggregates that are known, by ``Observation.get``, once an action has run over it: no second pass."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen

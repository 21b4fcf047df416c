"""A lazy result and the ways to end it."""

from __future__ import annotations

import dataclasses
import threading
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

from tessera.layout import Layout


class Cancelled(Exception):
    """The query was stopped by its deadline or its signal."""


class CancelSignal:
    """Stops the queries that run under it: by ``cancel()``, or when ``test`` turns true (asked every ``every`` seconds)."""

    def __init__(self, test: Callable[[], bool] | None = None, every: float = 0.2):
        self._event, self._test, self.every = threading.Event(), test, every

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        if self._test is not None and self._test():
            self._event.set()
        return self._event.is_set()


_numbers = iter(range(1, 1 << 62))


class Rows:
    """The rows of a DataFrame; nothing runs before a terminal is called."""

    def __init__(self, df: DataFrame, timeout: float | None = None, signal: CancelSignal | None = None):
        self._df, self._timeout, self._signal = df, timeout, signal

    @property
    def df(self) -> DataFrame:
        """The DataFrame under a plan of its own: one whose run was stopped doesn't spoil the next."""
        return self._df.select("*")

    def timeout(self, seconds: float) -> Rows:
        return Rows(self._df, seconds, self._signal)

    def under(self, signal: CancelSignal) -> Rows:
        return Rows(self._df, self._timeout, signal)

    def _run(self, work: Callable[[], Any]) -> Any:
        """Runs a terminal; its jobs are interrupted when time is up or the signal says so."""
        if self._timeout is None and self._signal is None:
            return work()
        context, tag, over = self._df.sparkSession.sparkContext, f"tessera-{next(_numbers)}", threading.Event()
        stopped = threading.Event()

        def watch() -> None:
            left = self._timeout
            while not over.is_set():
                step = self._signal.every if self._signal else left
                if over.wait(min(step, left) if left is not None else step):
                    return
                left = None if left is None else left - step
                if (left is not None and left <= 0) or (self._signal and self._signal.cancelled):
                    stopped.set()
                    context.cancelJobsWithTag(tag)
                    if over.wait(0.1):
                        return

        if self._signal and self._signal.cancelled:
            raise Cancelled("cancelled before it ran")
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            return work()
        except Exception as e:
            if stopped.is_set():
                raise Cancelled("stopped by its deadline or signal") from e
            raise
        finally:
            over.set()
            context.removeJobTag(tag)

    def collect(self) -> list[Row]:
        return self._run(self.df.collect)

    def scalar(self) -> Any:
        """First column of the only row; an error if there is none or another."""
        found = self._run(lambda: self.df.take(2))
        if len(found) != 1:
            raise LookupError("no row" if not found else "more than one row")
        return found[0][0]

    def scalar_optional(self) -> Any | None:
        """Like ``scalar``, but None if there is no row; a null value is an error that says so."""
        found = self._run(lambda: self.df.take(2))
        if len(found) > 1:
            raise LookupError("more than one row")
        if found and found[0][0] is None:
            raise LookupError("the value is null")
        return found[0][0] if found else None

    def list(self) -> list[Any]:
        return [r[0] for r in self.collect()]

    def records(self, cls: type) -> list[Any]:
        """Each row as an object of a dataclass, columns taken by position."""
        layout = Layout.of(cls)
        if len(layout.columns) != len(self.df.columns):
            raise LookupError(f"{cls.__name__} has {len(layout.columns)} fields, the rows have {len(self.df.columns)} columns")
        named = self.df.toDF(*[f.name for f in dataclasses.fields(cls)])
        return [layout.item(r) for r in self._run(named.collect)]

    def until(self, full: Callable[[Row], bool]) -> list[Row]:
        """Rows up to the first for which ``full`` is true, with it; a partition at a time, and later ones aren't made."""

        def work() -> list[Row]:
            found = []
            for row in self.df.toLocalIterator():
                found.append(row)
                if full(row):
                    break
            return found

        return self._run(work)

    def stream(self) -> Iterator[Row]:
        """Rows one partition at a time, which bounds what the driver holds."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def for_each(self, work: Callable[[Row], Any]) -> int:
        n = 0
        for row in self.stream():
            work(row)
            n += 1
        return n

    def for_each_value(self, work: Callable[[Any], Any]) -> int:
        return self.for_each(lambda r: work(r[0]))

    def count(self) -> int:
        return self._run(self.df.count)

    def arrow(self):
        return self._run(self.df.toArrow)

    def pandas(self):
        return self._run(self.df.toPandas)

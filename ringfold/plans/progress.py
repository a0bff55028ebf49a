"""Long searches in the background: progress, results, cancelling."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Progress(NamedTuple):
    """Tasks done of those known so far; later steps add theirs as they begin."""

    done: int
    total: int


class Cancelled(RuntimeError):
    """The search was cancelled before it had a result."""


class Search:
    """``work()`` on a thread of its own, whose jobs are one group.

    ``work`` should end with an action (``cut_lineage`` of what it finds, say),
    since what is only planned has nothing to show or to cancel. Other work of
    the session isn't touched by ``cancel``.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], object]):
        self._spark, self._work = spark, work
        self._group = f"ringfold-search-{uuid.uuid4().hex}"
        self._value: object = None
        self._error: BaseException | None = None
        self._cancelled = threading.Event()
        self._seen = Progress(0, 0)
        self._thread = InheritableThread(target=self._run, session=spark)
        self._thread.start()

    def _run(self) -> None:
        self._spark.sparkContext.setJobGroup(self._group, "ringfold search", interruptOnCancel=True)
        try:
            self._value = self._work()
        except BaseException as e:  # noqa: BLE001  raised again by ``result``
            self._error = e

    @property
    def running(self) -> bool:
        return self._thread.is_alive()

    def progress(self) -> Progress:
        """Never falls, neither in what is done nor in what is known of."""
        tracker = self._spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self._group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if (s := tracker.getStageInfo(stage)) is not None:
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        self._seen = Progress(max(done, self._seen.done), max(total, self._seen.total))
        return self._seen

    def updates(self, seconds: float = 0.2) -> Iterator[Progress]:
        """The progress whenever it has changed, until the search ends."""
        last = None
        while True:
            running, now = self.running, self.progress()
            if now != last:
                yield now
                last = now
            if not running:
                return
            time.sleep(seconds)

    def cancel(self, timeout: float = 60.0) -> None:
        """Stops the running jobs and those that would follow."""
        self._cancelled.set()
        end = time.monotonic() + timeout
        while self.running and time.monotonic() < end:
            self._spark.sparkContext.cancelJobGroup(self._group)
            self._thread.join(0.2)

    def result(self, timeout: float | None = None) -> object:
        """What the work gave; its error, or ``Cancelled``."""
        self._thread.join(timeout)
        if self.running:
            raise TimeoutError("the search is still running")
        if self._error is not None:
            if self._cancelled.is_set():
                raise Cancelled("the search was cancelled") from self._error
            raise self._error
        return self._value


def search(spark: SparkSession, work: Callable[[], object]) -> Search:
    """Starts ``work`` and gives its handle."""
    return Search(spark, work)

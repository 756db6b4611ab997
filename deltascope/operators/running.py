"""Work that can be watched and stopped while Spark runs it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")
#: Local properties of a job group, which a run borrows and gives back.
GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


class Cancelled(Exception):
    """A run was stopped by `cancel`."""


@dataclass(frozen=True)
class Progress:
    """Tasks of the jobs seen so far for the n-th of `of` tables; rows once it is whole. More tasks appear as Spark plans further stages."""

    table: str
    n: int
    of: int
    tasks_done: int
    tasks: int
    rows: int | None = None


class Run:
    """Calls `report` with the Progress of each table, every so many seconds while its jobs run and once at its end.

    `cancel` (from any thread), or an exception that `report` raises, ends the jobs
    that are running, within a table too; other jobs of the session go on. The
    exception, or Cancelled, is then raised where the work was started. One run
    takes one table at a time; jobs must be started from the thread of the work.
    """

    def __init__(self, spark: SparkSession, report: Callable[[Progress], None] | None = None, every: float = 0.5):
        self.context, self.report, self.every = spark.sparkContext, report, every
        self.tag, self._stopped, self._failure = f"deltascope-{uuid.uuid4().hex}", threading.Event(), None

    def cancel(self) -> None:
        self._stopped.set()
        self.context.cancelJobsWithTag(self.tag)

    def table(self, name: str, n: int, of: int, work: Callable[[], Result], rows: Callable[[Result], int]) -> Result:
        """The result of `work`, whose jobs are watched; `rows` tells how many rows it read."""
        group, ended = f"{self.tag}-{n}", threading.Event()
        watcher = threading.Thread(target=self._watch, args=(name, n, of, group, ended), daemon=True)
        self._raise_if_stopped()
        with self._marked(group, name):
            watcher.start()
            try:
                result = work()
            except Exception:
                self._raise_if_stopped()
                raise
            finally:
                ended.set()
                watcher.join()
        self._raise_if_stopped()
        if self.report is not None:
            done, tasks = self._tasks(group)
            self.report(Progress(name, n, of, done, tasks, rows(result)))
        return result

    def _raise_if_stopped(self) -> None:
        if self._stopped.is_set():
            raise self._failure or Cancelled("the run was cancelled")

    @contextmanager
    def _marked(self, group: str, what: str):
        """Jobs of this thread have the run's tag, by which they are cancelled, and a group, by which they are counted."""
        was = [self.context.getLocalProperty(p) for p in GROUP]
        self.context.addJobTag(self.tag)
        self.context.setJobGroup(group, what, True)
        try:
            yield
        finally:
            self.context.removeJobTag(self.tag)
            for name, value in zip(GROUP, was, strict=True):
                self.context.setLocalProperty(name, value)

    def _tasks(self, group: str) -> tuple[int, int]:
        tracker, stages = self.context.statusTracker(), set()
        for job in tracker.getJobIdsForGroup(group):
            found = tracker.getJobInfo(job)
            stages |= set(found.stageIds) if found else set()
        # a stage that Spark skips or forgets has no figures
        found = [s for s in map(tracker.getStageInfo, stages) if s is not None]
        return sum(s.numCompletedTasks for s in found), sum(s.numTasks for s in found)

    def _watch(self, name: str, n: int, of: int, group: str, ended: threading.Event) -> None:
        last = None
        while not ended.wait(self.every):
            if self._stopped.is_set():  # again and again: the work may be between two jobs
                self.context.cancelJobsWithTag(self.tag)
                continue
            now = self._tasks(group)
            if self.report is None or now == last:
                continue
            last = now
            try:
                self.report(Progress(name, n, of, *now))
            except Exception as failure:  # it is raised again where the work was started
                self._failure = failure
                self.cancel()

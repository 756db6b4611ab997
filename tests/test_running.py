"""Watching and stopping work within a table."""

import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.operators import snapshot as S
from deltascope.operators.running import Cancelled, Run
from deltascope.sources.catalog import FrameSource


@F.pandas_udf(T.LongType())
def slow(ids: pd.Series) -> pd.Series:
    time.sleep(0.4)
    return ids


def _source(spark, parts):
    """A table whose every task takes 0.4 s, and a quick one."""
    return FrameSource(spark, {"SLOW": lambda: spark.range(0, parts, 1, parts).select(slow.asNondeterministic()("id").alias("id")), "QUICK": lambda: spark.range(5)}, {})


def _no_jobs(spark):
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            return True
        time.sleep(0.1)
    return False


def test_a_table_reports_while_it_is_read(spark):
    spark.range(1).count()
    seen = []
    taken = S.take_snapshot(_source(spark, 16), run=Run(spark, seen.append, 0.1))
    within = [p for p in seen if p.table == "SLOW" and p.rows is None]
    assert len({p.tasks_done for p in within}) >= 2 and all(p.tasks_done <= p.tasks for p in seen)
    assert [p.tasks_done for p in within] == sorted(p.tasks_done for p in within)
    assert {p.table: p.rows for p in seen if p.rows is not None} == {"SLOW": 16, "QUICK": 5} == {n: t.n_rows for n, t in taken.tables.items()}
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None and not spark.sparkContext.getJobTags()


def test_a_report_that_raises_ends_the_jobs_of_its_table(spark):
    class Enough(Exception):
        pass

    seen = []

    def report(p):
        seen.append(p)
        if p.tasks_done:
            raise Enough

    with pytest.raises(Enough):
        S.take_snapshot(FrameSource(spark, {"SLOW": _source(spark, 400).table("SLOW").df}, {}), run=Run(spark, report, 0.1))
    assert _no_jobs(spark) and 0 < seen[-1].tasks_done < 400 and seen[-1].rows is None


def test_cancelling_from_another_thread_leaves_other_jobs_alone(spark):
    run, other = Run(spark), {}
    beside = threading.Thread(target=lambda: other.update(n=_source(spark, 8).table("SLOW").df.agg(F.sum("id")).first()[0]))
    timer = threading.Timer(1.0, run.cancel)
    beside.start()
    timer.start()
    with pytest.raises(Cancelled):
        S.take_snapshot(FrameSource(spark, {"SLOW": _source(spark, 400).table("SLOW").df}, {}), run=run)
    beside.join()
    assert other == {"n": 28} and _no_jobs(spark)
    with pytest.raises(Cancelled):  # a stopped run starts nothing more
        S.take_snapshot(_source(spark, 1), run=run)

"""Histories: one shuffle by person, in pieces of bounded size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobtrails.operators import sequences as SQ


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stint_repair_shuffles_by_person_once(spark):
    d = dt.date
    rows = [(1, 1, d(2000, 1, 1), None), (1, 2, None, d(2001, 5, 1)), (1, 3, d(2000, 3, 1), d(2002, 1, 1)),
            (1, 4, d(2000, 1, 1), d(2000, 3, 1)), (1, 5, d(2003, 1, 1), None), (2, 1, None, d(2000, 1, 1)),
            (None, 1, d(2000, 1, 1), None), (None, 2, d(2000, 6, 1), d(2000, 7, 1))]
    df = spark.createDataFrame(rows, "person_id int, pos int, start_dt date, end_dt date")
    out = SQ.stint_fill(df)
    assert _plan(out).count("Exchange hashpartitioning") == 1
    got = {(r.person_id, r.pos): (r.start_dt, r.end_dt) for r in out.collect()}
    assert got[1, 1] == (d(2000, 1, 1), d(2000, 3, 1))     # the next known date after the start
    assert got[1, 2] == (d(2000, 3, 1), d(2001, 5, 1))     # the last known date before the end
    assert got[1, 5] == (d(2003, 1, 1), d(2003, 1, 1))
    assert got[2, 1] == (d(2000, 1, 1), d(2000, 1, 1))
    assert got[None, 1] == (d(2000, 1, 1), d(2000, 1, 1))  # a null key knows no dates


def test_histories_are_dealt_by_rows(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 50).alias("p"), "id")
    monkeypatch.setattr(SQ, "TASK_ROWS", 10)
    out = SQ.by_size(rows, "p", lambda x: x.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("p"))), None)
    plan = _plan(out)
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
    assert out.count() == 400 and out.where("n != 8").isEmpty()

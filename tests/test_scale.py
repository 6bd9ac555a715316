"""Steps that must not cost more than their rows need."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from jobtrails.session import stage_path
from jobtrails.sources import resume_xml as RX
from jobtrails.sources import tables as V

SF001 = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_jobs_by_person_needs_no_further_shuffle(spark):
    jobs = V.jobs_v(V.Tables(spark, SF001))
    grouped = jobs.groupBy("person_id").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    assert _plan(grouped).count("Exchange hashpartitioning") == _plan(jobs).count("Exchange hashpartitioning")


def test_shards_hold_no_indentation(spark):
    t = V.Tables(spark, SF001)
    even, odd = RX.write_shards(RX.resume_frame(V.jobs_v(t), t.customer, t.nation), stage_path(spark, "xml_plain"))
    assert spark.read.text(even).where(F.col("value").rlike(r"^\s+<")).isEmpty()
    ids = {r[0] for r in RX.read_resumes(spark, [even, odd]).select("ResumeID").collect()}
    assert ids == {str(r[0]) for r in t.customer.select("c_custkey").collect()}
    assert all(f.endswith(".gz") for f in glob.glob(odd.removeprefix("file://") + "/part-*"))

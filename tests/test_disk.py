"""Steps must not leave on disk what nobody reads any more, and do the whole job."""

from __future__ import annotations

import datetime
import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobtrails.operators import joins as JN
from jobtrails.operators import sequences as SQ
from jobtrails.operators import topics as TOP
from jobtrails.plans.catalog import QUERIES
from jobtrails.session import shuffles_freed, stage_path
from jobtrails.sources import resume_xml as RX
from jobtrails.sources import sequences_io as SIO
from jobtrails.sources import tables as V
from tests.conftest import SF001

D = datetime.date


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_stints_leave_no_shuffle_files(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("person_id"), F.col("id").alias("pos"),
                                   F.lit(D(2000, 1, 1)).alias("start_dt"), F.lit(D(2001, 1, 1)).alias("end_dt"))
    before = _shuffle_files(spark)
    out = SQ.stint_fill(rows.repartition(3, "pos"), skew_safe=True)
    assert not _shuffle_files(spark) - before
    assert out.count() == 200


def test_the_setting_of_the_session_stays(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        1 / 0
    assert spark.conf.get(key) == before


def test_jobs_are_the_same_with_a_table_in_between(spark):
    t = V.Tables(spark, SF001)
    plain = V.jobs_v(t)
    kept = V.jobs_v(t, ("company",), keep=lambda j: j.checkpoint())
    assert kept.columns == ["job_id", "person_id", "pos", "start_dt", "end_dt", "company"]
    assert plain.select(kept.columns).exceptAll(kept).isEmpty() and kept.count() == plain.count()


def test_matching_reads_filled_histories_from_files(spark):
    assert "Window" not in _plan(QUERIES["match_by_fingerprint"](spark, SF001))


def test_alignment_deals_each_history_once(spark):
    assert _plan(QUERIES["align_positional"](spark, SF001)).count("Exchange hashpartitioning") == 2


def test_alignment_with_null_and_repeated_keys(spark):
    rng = random.Random(4)

    def rows(job):
        day = lambda: rng.choice([None, D(2000, 1, 1), D(2000, 2, 1)])
        return [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 1, 2, 3]), day(), day(), f"{job}{i}") for i in range(30)]

    a, b = rows("l"), [*rows("r"), (9, 1, None, None, "r")]
    schema = "person_id int, seq_pos int, start_dt date, end_dt date, job_id string"
    got = JN.align_positional(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema),
                              "person_id", "seq_pos", "start_dt", "end_dt")
    sizes = [Counter(r[0] for r in x) for x in (a, b)]
    met = [(x, y) for x in a for y in b if None not in x[:2] and x[:2] == y[:2]]
    none = (None,) * 5
    met += [(x, none) for x in a if all(x is not y for y, _ in met)]
    met += [(none, y) for y in b if all(y is not z for _, z in met)]
    want = []
    for x, y in met:
        seq, pos = (x if x is not none else y)[:2]
        same = sizes[0][seq] == sizes[1][seq]
        want.append((seq, pos, x[4], y[4], "bad_length" if not same else "match" if x[2:4] == y[2:4] else "bad_job"))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_sequence_files_are_gzipped(spark):
    rows = [(p, i, D(2000, 1, 1), D(2001, 1, i), "c", f"d{i}", [float(i)]) for p in (1, 2) for i in (1, 2)]
    df = spark.createDataFrame(rows, "person_id bigint, seq_pos bigint, start_dt date, end_dt date, company string, "
                                     "description string, topics array<double>")
    path = stage_path(spark, "jsonl_small")
    SIO.write_sequences_jsonl(df, path, vector="topics")
    files = glob.glob(path.removeprefix("file://") + "/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    assert sorted(map(tuple, SIO.read_sequences_jsonl(spark, path).collect())) == rows


def test_both_shards_are_gzipped(spark):
    rows = spark.range(0, 20, 1, 2).select(F.col("id").cast("string").alias("ResumeID"))
    shards = RX.write_shards(rows, stage_path(spark, "xml_two"))
    for s in shards:
        files = glob.glob(s.removeprefix("file://") + "/part-*")
        assert files and all(f.endswith(".gz") for f in files)
    assert RX.read_resumes(spark, shards).select("ResumeID").distinct().count() == 20


def test_topic_fit_keeps_two_tables_of_weights(spark):
    docs = spark.createDataFrame([(i, f"red fox {'sat' if i % 2 else 'ran'} here") for i in range(12)], "id int, text string")
    counts = TOP.term_counts(docs, "id", "text")
    folder = os.path.dirname(counts.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    tables = lambda: set(glob.glob(f"{folder}/lda_weights-*"))
    blocks = lambda: set(glob.glob(f"{folder}/lda_blocks-*"))
    old, packed = tables(), blocks()
    model = TOP.fit_lda(docs, "id", "text", k=2, max_iter=5, counts=counts)
    assert len(tables() - old) == 2
    shared = {r["id"]: r["topics"] for r in TOP.lda_doc_topics(model, docs, "id", "text", counts=counts).collect()}
    assert len(blocks() - packed) == 1
    model.corpus = None
    again = {r["id"]: r["topics"] for r in TOP.lda_doc_topics(model, docs, "id", "text", counts=counts).collect()}
    assert shared == again and len(shared) == 12

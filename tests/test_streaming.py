"""Streaming ingestion of résumé shards equals the batch ETL."""

import os
import tempfile

from jobtrails.session import stage_path
from jobtrails.sources import resume_xml as RX
from jobtrails.sources import tables as V
from jobtrails.streaming import ingest
from tests.conftest import SF001


def test_stream_ingest_matches_batch(spark):
    t = V.Tables(spark, SF001)
    shards = RX.write_shards(RX.resume_frame(V.jobs_v(t), t.customer, t.nation), stage_path(spark, "xml_stream"))
    inbox = os.path.dirname(shards[0])
    out = tempfile.mkdtemp(prefix="ingest-")
    ingest(spark, os.path.join(inbox, "*"), out, checkpoint=os.path.join(out, "_ckpt"), max_files=1)
    batch = RX.read_resumes(spark, shards)
    for name, job in (("resumes", RX.etl_resumes), ("jobs", RX.etl_jobs), ("schools", RX.etl_schools)):
        got = spark.read.parquet(os.path.join(out, name)).drop("batch")
        want = job(batch)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0
    # two shards, one file per trigger -> two micro-batches
    assert spark.read.parquet(os.path.join(out, "resumes")).select("batch").distinct().count() == 2

"""Incremental ingestion of résumé XML shards.

The reference has no stream processing; its loader only commits every
thousand records while it walks the files.  The Spark form of that is a
file-source stream: new shards dropped into a folder are read with the
explicit résumé schema, and each micro-batch runs the three ETL jobs and
writes their tables.  Writes are idempotent per batch (dynamic partition
overwrite on ``batch``), and the stream checkpoint records which files are
done, so a restarted or retried batch neither loses nor duplicates rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrails.session import checkpoint_dir
from jobtrails.sources import resume_xml as RX

ETL = {"resumes": RX.etl_resumes, "jobs": RX.etl_jobs, "schools": RX.etl_schools}


def resume_stream(spark: SparkSession, in_dir: str, max_files: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("xml").option("rowTag", "resume")
                   .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
                   .schema(RX.RESUME_SCHEMA))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(in_dir)


def ingest(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str | None = None,
           max_files: int | None = None, available_now: bool = True):
    """Run the ETL jobs over every new shard; returns the finished query
    (``available_now``) or the running one."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "resume-ingest")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, job in ETL.items():
            (job(batch).withColumn("batch", F.lit(batch_id))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch").parquet(os.path.join(out_dir, name)))
        batch.unpersist()

    w = (resume_stream(spark, in_dir, max_files).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q

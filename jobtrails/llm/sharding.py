"""Contiguous shards of nearly equal bytes from global prefix sums.

Documents are put in one order (text fingerprint, so that equal texts stand
together, then id).  The order is cut into range partitions; per-partition
totals give every partition its place, and a row's place is that plus its
partition's running sum.  Shard s takes the places from s/n to (s+1)/n of all
bytes, judged by a row's middle.  A group of equal texts follows its first row, unless it reaches more
than ``GROUP_SLACK`` of a shard beyond it: then the rest goes by its own place,
so that a large group is split.

Edge cases: a null text has no bytes, size ``OVERHEAD`` and crc 0.  Null ids
come first among equal texts.  Repeated rows are rows of their own.  Fewer
rows than shards leave some shards empty; no rows give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrails.llm.common import arrow_schema, batch, materialise

OVERHEAD = 8
GROUP_SLACK = 0.02


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, group_slack: float = GROUP_SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place within the shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"),
                       (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
                       F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("at"))
    order = ["h", "text_crc32", "size", "doc_id", "at"]
    ddl = ("part bigint, row bigint, before bigint, head_row boolean, group_start bigint, doc_id bigint, "
           "size bigint, text_crc32 bigint, h bigint")
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id().cast("bigint"))
                         .mapInArrow(_running(ddl), ddl), "shard-places")

    # one row per partition: the totals, and what its first group needs from earlier partitions
    parts = placed.groupBy("part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("h", "text_crc32", "size"), "row").alias("first"),
        F.max_by(F.struct("h", "text_crc32", "size"), "row").alias("last"),
        F.max("group_start").alias("last_start")).orderBy("part").collect()
    starts, total, count, open_key, open_start = [], 0, 0, None, 0
    for p in parts:
        head = open_start if p["first"] == open_key else total
        starts.append((p["part"], total, count, head))
        if not (p["first"] == p["last"] == open_key):
            open_start = head if p["last_start"] == 0 else total + p["last_start"]
        open_key, total, count = p["last"], total + p["bytes"], count + p["n"]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(starts, "part bigint, byte0 bigint, row0 bigint, head bigint")

    # a few numbers for each partition of the order: bounded by the task count, not the rows
    d = placed.join(F.broadcast(offsets), "part")
    place = F.col("byte0") + F.col("before")
    start = F.when(F.col("head_row"), F.col("head")).otherwise(F.col("byte0") + F.col("group_start"))
    share = max(total, 1) / n_shards
    anchor = F.when(place - start <= group_slack * share, start).otherwise(place) + F.col("size") / 2
    d = d.select("doc_id", "size", "text_crc32", (F.col("row0") + F.col("row")).alias("row"),
                 F.least(F.floor(anchor / F.lit(float(share))), F.lit(n_shards - 1)).cast("int").alias("shard"))
    firsts = d.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return d.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def _running(ddl: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        row, total, key, start, head = 0, 0, None, 0, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = {k: b[k].to_numpy(zero_copy_only=False) for k in ("size", "text_crc32", "h")}
            before = total + np.cumsum(cols["size"]) - cols["size"]
            new = np.ones(n, bool)
            new[1:] = ((cols["h"][1:] != cols["h"][:-1]) | (cols["text_crc32"][1:] != cols["text_crc32"][:-1])
                       | (cols["size"][1:] != cols["size"][:-1]))
            first = (cols["h"][0], cols["text_crc32"][0], cols["size"][0])
            new[0] = key is not None and first != key
            if key is None:
                start = 0
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            group_start = np.where(at >= 0, before[np.maximum(at, 0)], start)
            head_row = (at < 0) & head
            yield batch(schema, part=b["part"], row=row + np.arange(n), before=before, head_row=head_row,
                        group_start=group_start, doc_id=b["doc_id"], size=b["size"],
                        text_crc32=b["text_crc32"], h=b["h"])
            row, total, start = row + n, int(before[-1] + cols["size"][-1]), int(group_start[-1])
            head = bool(head_row[-1])
            key = (cols["h"][-1], cols["text_crc32"][-1], cols["size"][-1])

    return run

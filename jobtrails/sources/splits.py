"""Train / held-out splits."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_sequences(seqs: DataFrame, seq: str, n_train: int) -> DataFrame:
    """The first ``n_train`` sequences (by key) are ``train``, the rest
    ``test``.  The cut key is found with a top-n of the distinct keys (a
    per-task top-n plus one small merge), not a global row numbering."""
    keys = seqs.select(seq).distinct().orderBy(seq).limit(n_train)
    cut = keys.select(F.max(seq)).scalar()
    return seqs.withColumn("split", F.when(F.col(seq) <= cut, "train").otherwise("test"))


def split_by_hash(seqs: DataFrame, seq: str, train_pct: int) -> DataFrame:
    """``train`` for about ``train_pct`` of a hundred sequences by a hash of
    the key, the rest ``test``: a share that grows with the data, without a sort."""
    bucket = F.conv(F.substring(F.md5(F.col(seq).cast("string")), 1, 4), 16, 10).cast("int") % 100
    return seqs.withColumn("split", F.when(F.coalesce(bucket, F.lit(99)) < train_pct, "train").otherwise("test"))


def split_files(paths: list[str], skip: int, n: int) -> list[str]:
    """Shards [skip, skip + n) of the sorted listing (train or held-out)."""
    return sorted(paths, key=os.path.basename)[skip:skip + n]

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrails.session import checkpoint_dir, stage_path

#: ASCII white space that separates words in every contract of this folder
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage in storage that outlives any executor."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folds(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as remainder 0, so that
    nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; a
    null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


def slices(off: np.ndarray, size: int):
    """(first row, last row) ranges of about ``size`` bytes; a row is whole."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type)
         for k, c in ((k, cols[k]) for k in schema.names)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of flat ``name type`` pairs as Spark names them."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ", 1) for x in ddl.split(","))])


def shield(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with every column but text renamed, so that a method's own
    columns can't clash with the caller's, and the columns that undo it."""
    names = {c: c if c == "text" else f"__in_{c}" for c in docs.columns}
    return docs.withColumnsRenamed(names), [F.col(f"`{n}`").alias(c) for c, n in names.items()]

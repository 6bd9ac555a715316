"""Compression classifier for quality (operator 12).

Two zstandard dictionaries are built, one from good and one from bad labelled
text.  Every text is cut into blocks of ``BLOCK`` bytes, each block is
compressed with either dictionary, and the difference of the compressed sizes
(bad less good, summed over all blocks) is normalised by the text's bytes:

    value = (bad_bytes - good_bytes + SHRINK * mean) / (n_bytes + SHRINK)

where ``mean`` is the labelled texts' mean difference a byte; it stands for
``SHRINK`` bytes more, so that a short text isn't judged by the header of a
frame.  Per byte of text, not of compressed text: a text that repeats itself
has few compressed bytes for either dictionary, and so a difference near zero,
well below that of prose.  A logistic curve over the labelled texts that the
dictionaries haven't seen turns the value into the score.

Learned from: fold 0 of ``n_folds`` never; of the others, the lower half makes
the dictionaries, the upper half the curve.  The dictionaries are fitted on a
bounded sample (``MAX_DOCS`` labelled documents a class by hash, ``MAX_BLOCKS``
distinct blocks a class by hash); mean, curve and scores use all rows.

Results for odd rows: null and empty texts have value ``mean``; a null doc_id
counts as held out; repeated rows score alike; labels of several rows are good
if one is; without labels of both classes every score is the share of good
labels (0.5 without any).  Very long texts are blocks like others.  An empty
table gives no rows.  Only doc_id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtrails.llm.common import arrow_schema, batch, folds, materialise

BLOCK = 1024
LEVEL = 3
DICT_BYTES = 1 << 16
SHRINK = 100
MAX_DOCS = 8192
MAX_BLOCKS = 4096
CUT = 0.3

_BIN = 5e-4
_SIZES = "n_bytes bigint, good_bytes bigint, bad_bytes bigint"


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_py() for x in pc.cast(b["text"].fill_null(""), pa.large_binary()))


def sample_blocks(docs: DataFrame, truth: DataFrame) -> dict[int, list[bytes]]:
    """At most MAX_BLOCKS distinct blocks of each class, in order of their hash."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("quality int, block binary")
        for b in batches:
            for text, q in zip(_texts(b), b["quality"].to_pylist(), strict=True):
                found = list(dict.fromkeys(x for x in blocks(text) if len(x) >= 8))
                for i in range(0, len(found), MAX_BLOCKS):
                    some = found[i:i + MAX_BLOCKS]
                    yield batch(schema, quality=[q] * len(some), block=some)

    # at most MAX_DOCS narrow rows a class: the texts stay where they are and are read once
    first, second = (truth.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS)
                     for q in (0, 1))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(
        F.broadcast(first.unionByName(second)), "doc_id").select("text", "quality")
    found = materialise(texts.mapInArrow(cut, "quality int, block binary").distinct(), "zstd-blocks")
    return {q: [bytes(r["block"]) for r in found.where(F.col("quality") == q).select("block")
                .orderBy(F.xxhash64("block"), "block").limit(MAX_BLOCKS).collect()] for q in (0, 1)}


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(data)  # trained ones by their magic number, others as content
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, write_checksum=False, write_content_size=False,
                                    write_dict_id=False)


def sizes(docs: DataFrame, keep: list[str], good: bytes, bad: bytes) -> DataFrame:
    """The columns ``keep`` and each text's bytes, plain and by either dictionary."""
    out = StructType(docs.select(*keep).schema.fields + StructType.fromDDL(_SIZES).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_SIZES)
        by = [compressor(good), compressor(bad)]
        for b in batches:
            plain, packed = [], ([], [])
            for text in _texts(b):
                plain.append(len(text))
                parts = blocks(text)
                for c, found in zip(by, packed, strict=True):
                    found.append(sum(len(c.compress(x)) for x in parts))
            found = batch(schema, n_bytes=plain, good_bytes=packed[0], bad_bytes=packed[1])
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), *found.columns], names=[*keep, *schema.names])

    return docs.select(*keep, "text").mapInArrow(run, out)


def logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and intercept over binned counts: Newton steps, ridge 1e-3, halved while they don't help."""
    z = np.stack([x, np.ones_like(x)], 1)

    def loss(w):
        t = z @ w
        return float(pos @ np.logaddexp(0, -t) + neg @ np.logaddexp(0, t) + 5e-4 * w @ w)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ ((pos + neg) * p - pos) + 1e-3 * w
        h = (z * ((pos + neg) * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_quality(docs: DataFrame, labels: DataFrame, n_folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, value, n_bytes, good_bytes and
    bad_bytes of every document."""
    fold = folds(F.col("doc_id"), n_folds)
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold != 0)).groupBy("doc_id").agg(
        F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    first = fold <= n_folds // 2
    d = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    samples = sample_blocks(docs, truth.where(first))
    if not samples[0] or not samples[1]:
        seen = truth.agg(F.avg("quality")).first()[0]
        flat = 0.5 if seen is None else float(seen)
        n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
        none = [F.lit(None).cast("bigint").alias(c) for c in ("good_bytes", "bad_bytes")]
        return d.select("doc_id", "held_out", F.lit(flat).alias("score"), F.lit(int(flat >= CUT)).alias("predicted"),
                        F.lit(0.0).alias("value"), n.alias("n_bytes"), *none)
    found = materialise(sizes(d, ["doc_id", "held_out"], train(samples[1]), train(samples[0])), "zstd-sizes")

    known = found.where(~F.col("held_out")).join(truth, "doc_id")
    unseen = known.where(~first)
    diff = F.col("bad_bytes") - F.col("good_bytes")
    n, kinds, total, moved = unseen.agg(F.count(F.lit(1)), F.count_distinct("quality"), F.sum("n_bytes"),
                                        F.sum(diff)).first()
    if kinds < 2:  # too few labels to keep any apart
        unseen = known
        n, kinds, total, moved = unseen.agg(F.count(F.lit(1)), F.count_distinct("quality"), F.sum("n_bytes"),
                                            F.sum(diff)).first()
    mean = moved / total if total else 0.0
    value = (diff + SHRINK * mean) / (F.col("n_bytes") + SHRINK)
    # a difference is at most a few bytes a byte of text: some thousand bins
    bins = unseen.select(F.round(value / _BIN).alias("x"), "quality").groupBy("x").agg(
        F.sum("quality").alias("pos"), F.sum(1 - F.col("quality")).alias("neg")).toPandas()
    slope, cut = logistic(bins["x"].to_numpy(float) * _BIN * 100, bins["pos"].to_numpy(float), bins["neg"].to_numpy(float))
    return found.withColumn("value", value).withColumn(
        "score", 1 / (1 + F.exp(-(F.col("value") * (100 * slope) + cut)))).select(
        "doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "value", "n_bytes",
        "good_bytes", "bad_bytes")

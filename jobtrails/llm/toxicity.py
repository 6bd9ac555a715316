"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is its log-odds in toxic against clean documents under
Dirichlet priors: a token's counts are shrunk to those of its stem (first
bytes), a stem's to the corpus shares, so that rare inflections of a toxic stem
score like the stem.  A linear scan finds all maximal segments; what a passage
scores doesn't depend on what stands before it.  A segment of
score S among n tokens is judged by the extreme-value law
E = K n exp(-lambda S): lambda solves sum p exp(lambda s) = 1 over the clean
token distribution and K comes from the mean largest segment of clean training
documents, of the same S.  A segment is significant if E is at most ``LEVEL``.

As evidence a segment counts W, lambda times what its best part scores if the r-th
of equal tokens in the segment has 1/r of a positive score, and these have a K of
their own, from the mean largest W of clean training documents.  A document's
evidence is the best sum over its r best segments, sum(W_i) - r ln(K n) + ln r!; a
logistic curve fitted on the training documents (in bins of the evidence) turns it
into a probability.

Tokens and stems are hashed into a fixed number of buckets, so the model has
one size for any corpus.  It is fitted on at most ``MAX_LABELS`` labelled rows;
all documents are scored.

Edge cases: a null or empty text has no tokens, no segment and the score of no
evidence.  Several labels of a document: toxic if one says so.  A null id has no
label.  Repeated rows are each scored.  Without labels every score is the
prior's.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtrails.llm.common import arrow_schema, batch, folds, materialise

WORD_BUCKETS = 1 << 19
STEM_BUCKETS = 1 << 17
STEM = 4
WORD_PRIOR = 20.0
STEM_PRIOR = 30.0
#: taken from every token's score so that clean text drifts down
DRIFT = 0.5
MIN_K = 0.01
#: a segment is significant if so few of its score are expected in a clean text of its length
LEVEL = 0.01
#: labelled rows that the classifier is fitted on at most (16 bytes each go to every task);
#: beyond this a share of them by a hash of the id
MAX_LABELS = 1_000_000
MEMO = 400_000
BIN = 0.25
LOWEST, HIGHEST = -12.0, 120.0
_EULER = 0.5772156649
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII bytes of a lower-cased text."""
    return text.translate(_FOLD).split()


def buckets(token: bytes) -> tuple[int, int]:
    return crc32(token) % WORD_BUCKETS, WORD_BUCKETS + crc32(token[:STEM]) % STEM_BUCKETS


class _Memo(dict):
    """token -> value, computed on first use and forgotten when large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token):
        if len(self) > MEMO:
            self.clear()
        value = self[token] = self.make(token)
        return value


@dataclass
class Scores:
    n1: np.ndarray     # word buckets in toxic rows
    n0: np.ndarray     # and in others
    stem: np.ndarray   # toxic share of each stem bucket
    share: float       # toxic share of all tokens
    scale: float       # lambda

    def of(self, token: bytes) -> float:
        w, s = buckets(token)
        p = self.stem[s - WORD_BUCKETS]
        p = (self.n1[w] + WORD_PRIOR * p) / (self.n1[w] + self.n0[w] + WORD_PRIOR)
        return log(p / (1 - p)) - log(self.share / (1 - self.share)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time
    (each candidate is pushed once and merged once)."""
    if not len(scores) or scores.max() <= 0:
        return []
    turn = np.flatnonzero(np.diff(scores > 0)) + 1
    starts = np.concatenate([[0], turn])
    sums = np.add.reduceat(scores, starts)
    ends = np.concatenate([turn, [len(scores)]])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total = 0.0
    for a, b, x in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        left, total = total, total + x
        if x <= 0:
            continue
        start, right = a, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]  # everything between has a larger sum before it
            if j < 0 or found[j][3] >= right:
                found.append((start, b, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r, _ in found]


def damped(words: list[bytes], scores: np.ndarray) -> float:
    """Best sum of neighbours in a segment whose r-th of equal words counts 1/r
    of a positive score."""
    seen: dict[bytes, int] = {}
    best = total = 0.0
    for word, x in zip(words, scores.tolist(), strict=True):
        if x > 0:
            seen[word] = r = seen.get(word, 0) + 1
            x /= r
        total = max(total + x, 0.0)
        best = max(best, total)
    return best


def _labelled(docs: DataFrame, labels: DataFrame, n_folds: int) -> tuple[DataFrame, DataFrame]:
    """Training labels, one row a document, and the training texts."""
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (folds(F.col("doc_id"), n_folds) != 0)
                         ).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = truth.count()
    if n > MAX_LABELS:
        share = int(0.99 * MAX_LABELS / n * (1 << 30))
        truth = truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    truth = F.broadcast(truth)  # so that the texts stay where they are
    texts = docs.where(F.col("text").isNotNull() & (folds(F.col("doc_id"), n_folds) != 0)).select("doc_id", "text")
    return truth, texts.join(truth, "doc_id").select("text", "toxic")


def fit_scores(rows: DataFrame) -> Scores | None:
    """Token scores from the columns text and toxic, by the number of texts that
    hold a token (a word repeated in one text is one); None without both labels."""
    ddl = "bucket int, n1 bigint, n0 bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, memo = arrow_schema(ddl), _Memo(buckets)
        sums = np.zeros((2, WORD_BUCKETS + STEM_BUCKETS), np.int64)
        for b in batches:
            texts = pc.cast(pc.utf8_lower(b["text"].cast(pa.string())), pa.binary()).to_pylist()
            for text, toxic in zip(texts, b["toxic"].to_pylist(), strict=True):
                ids = np.array(list(map(memo.__getitem__, set(tokens(text)))), np.int64)
                if len(ids):
                    np.add.at(sums[0 if toxic else 1], ids.ravel(), 1)
        some = np.flatnonzero(sums.sum(0))
        yield batch(schema, bucket=some.astype(np.int32), n1=sums[0, some], n0=sums[1, some])

    found = rows.mapInArrow(count, ddl).groupBy("bucket").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()  # at most all buckets
    n1, n0 = np.zeros(WORD_BUCKETS + STEM_BUCKETS), np.zeros(WORD_BUCKETS + STEM_BUCKETS)
    at = found["bucket"].to_numpy(np.int64)
    n1[at], n0[at] = found["n1"], found["n0"]
    total1, total0 = n1[:WORD_BUCKETS].sum(), n0[:WORD_BUCKETS].sum()
    if not total1 or not total0:
        return None
    share = total1 / (total1 + total0)
    stem = (n1[WORD_BUCKETS:] + STEM_PRIOR * share) / (n1[WORD_BUCKETS:] + n0[WORD_BUCKETS:] + STEM_PRIOR)
    n1, n0 = n1[:WORD_BUCKETS], n0[:WORD_BUCKETS]
    # the clean token distribution over the scores, by word bucket (its usual stem isn't known
    # there: the share of the bucket itself stands for it)
    p = (n1 + WORD_PRIOR * share) / (n1 + n0 + WORD_PRIOR)
    s = np.log(p / (1 - p)) - log(share / (1 - share)) - DRIFT
    q = n0 / total0
    low, high = 1e-3, 1.0
    while (q * np.exp(np.minimum(high * s, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (q * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return Scores(n1, n0, stem, share, (low + high) / 2)


SEGMENTS_DDL = ("n_tokens bigint, seg_start array<int>, seg_end array<int>, seg_score array<double>, "
                "seg_weight array<double>")


def score_segments(docs: DataFrame, model: Scores, keep: list[str]) -> DataFrame:
    """The columns ``keep``, n_tokens and every segment that can be significant
    (token places, lambda * score and what of it counts as evidence) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType(docs.select(*keep).schema.fields + StructType.fromDDL(SEGMENTS_DDL).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, m = arrow_schema(SEGMENTS_DDL), shared.value
        memo = _Memo(m.of)
        for b in batches:
            texts = pc.cast(pc.utf8_lower(b["__text"].fill_null("").cast(pa.string())), pa.binary()).to_pylist()
            count, starts, ends, values, weights = [], [], [], [], []
            for text in texts:
                words = tokens(text)
                s = np.array(list(map(memo.__getitem__, words)), float)
                # K is MIN_K at least, so what falls below this is insignificant for any K
                least = log(max(len(s), 1) * MIN_K)
                found = [(a, z, x * m.scale) for a, z, x in segments(s) if x * m.scale > least]
                count.append(len(s))
                starts.append([x[0] for x in found])
                ends.append([x[1] for x in found])
                values.append([x[2] for x in found])
                weights.append([damped(words[a:z], s[a:z]) * m.scale for a, z, _ in found])
            found = batch(schema, n_tokens=count, seg_start=starts, seg_end=ends, seg_score=values,
                          seg_weight=weights)
            rest = [i for i, name in enumerate(b.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *found.columns],
                                             names=[*(b.schema.names[i] for i in rest), *schema.names])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, out)


def evidence(log_k: float) -> Column:
    """Best sum statistic over the r best segments of a row."""
    best = F.reverse(F.array_sort("seg_weight"))
    cost = F.log(F.greatest(F.col("n_tokens"), F.lit(1))) + log_k
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("r"), F.lit(float(LOWEST)).alias("best"))

    def step(acc, x):
        r = acc["r"] + 1
        total = acc["sum"] + x - cost + F.log(r.cast("double"))  # ln r! grows by ln r
        return F.struct(total.alias("sum"), r.alias("r"), F.greatest(acc["best"], total).alias("best"))

    found = F.aggregate(best, start, step, lambda acc: acc["best"])
    return F.least(F.greatest(found, F.lit(float(LOWEST))), F.lit(float(HIGHEST)))


def _log_k(clean: DataFrame, values: str) -> float:
    """ln K from the largest of ``values`` in clean documents: the mean of a
    largest value among n tokens is ln(K n) plus Euler's constant."""
    largest = F.coalesce(F.array_max(values), F.lit(0.0)) - F.log("n_tokens")
    mean = clean.agg(F.avg(largest)).first()[0]
    return max(log(MIN_K), (mean if mean is not None else 0.0) - _EULER)


def _logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method on binned counts, ridge 1e-3."""
    w = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ ((pos + neg) * p - pos) + 1e-3 * w
        h = (z * ((pos + neg) * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, n_folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, n_tokens, the segments that
    any K could make significant (seg_start, seg_end, seg_score: lambda S, seg_e: E)
    and n_segments, the number of significant ones, of every document; learned
    from the labels of the folds other than 0."""
    fold = folds(F.col("doc_id"), n_folds)
    truth, rows = _labelled(docs, labels, n_folds)
    model = fit_scores(rows)
    d = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    if model is None:
        seen = truth.groupBy().agg(F.avg("toxic")).first()[0]
        flat = 0.0 if seen is None else float(seen)
        empty = [F.array().cast(t).alias(n) for n, t in
                 (("seg_start", "array<int>"), ("seg_end", "array<int>"), ("seg_score", "array<double>"),
                  ("seg_e", "array<double>"))]
        return d.select("doc_id", "held_out", F.lit(flat).alias("score"), F.lit(int(flat >= 0.5)).alias("predicted"),
                        F.lit(LOWEST).alias("evidence"), F.lit(0).cast("bigint").alias("n_tokens"), *empty,
                        F.lit(0).alias("n_segments"))
    found = materialise(score_segments(d, model, ["doc_id", "held_out"]), "toxic-segments")

    known = found.where(~F.col("held_out")).join(truth, "doc_id").where(F.col("n_tokens") > 0)
    clean = known.where(F.col("toxic") == 0)
    log_k, seg_log_k = _log_k(clean, "seg_weight"), _log_k(clean, "seg_score")
    bins = known.select((F.round(evidence(log_k) / BIN) * BIN).alias("x"), "toxic").groupBy("x").agg(
        F.sum((F.col("toxic") > 0).cast("int")).alias("pos"), F.sum((F.col("toxic") == 0).cast("int")).alias("neg")
    ).toPandas()  # at most (HIGHEST - LOWEST) / BIN + 1 rows
    slope, cut = _logistic(*(bins[c].to_numpy(float) for c in ("x", "pos", "neg")))
    expected = F.transform("seg_score", lambda x: F.exp(F.log("n_tokens") + seg_log_k - x))
    return found.withColumn("evidence", evidence(log_k)).withColumn(
        "score", 1 / (1 + F.exp(-(F.col("evidence") * slope + cut)))).withColumn("seg_e", expected).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "n_tokens",
        "seg_start", "seg_end", "seg_score", "seg_e",
        F.size(F.filter("seg_e", lambda e: e <= LEVEL)).alias("n_segments"))

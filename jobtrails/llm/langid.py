"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over
hashed byte n-grams (naive Bayes log-odds of the languages whose bit is set
against the others, every language with equal weight) predicts it.  Decoding
sums a logistic loss over the bits, weighted by how well each classifier did
for each language in training, and takes the codeword of the least loss; texts
whose two best codewords are close are flagged ambiguous.

All labelled training rows are counted; the model is ``N_BUCKETS`` weights a
bit, whatever the size of the corpus.

Edge cases: a null text or one without a letter is ``und`` with score 0 and
flagged.  Texts with letters always get a learned language; with nothing
learned all are ``und``.  Null languages teach nothing.  Repeated rows count
each time.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrails.llm.common import arrow_schema, batch, folds, shield, slices, utf8

N_BUCKETS = 1 << 18
GRAM = 4
SMOOTHING = 0.5
MIN_MARGIN = 0.02
SLICE_BYTES = 1 << 20
_SPACE = 32
#: ASCII bytes that aren't letters become spaces
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else _SPACE for b in range(256)], np.uint8)


def grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the rows: first row, last row, a bucket for each byte
    position (``N_BUCKETS``: none), and the rows' offsets into these."""
    padded = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_lower(texts.fill_null("").cast(pa.string())),
                                         pa.scalar(" "), "")
    off, data = utf8(padded)
    data = _FOLD[data]
    for a, b in slices(off, SLICE_BYTES):
        d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
        n = len(d) - GRAM + 1
        ids = np.full(len(d), N_BUCKETS, np.int32)
        if n > 0:
            packed = np.zeros(n, np.uint32)
            for i in range(GRAM):
                packed |= d[i:i + n].astype(np.uint32) << np.uint32(8 * i)
            ids[:n] = (packed * np.uint32(2654435761)) >> np.uint32(32 - 18)
            blank = d == _SPACE
            ids[:n][blank[:n] & blank[1:n + 1]] = N_BUCKETS  # runs of spaces say nothing
        for i in range(1, GRAM):  # n-grams that would run into the next text
            ids[np.maximum(o[1:] - i, o[:-1])] = N_BUCKETS
        yield a, b, ids, o


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1/-1 bits: all different splits for up to 5 languages, else
    the best separated of some random codes, no column constant."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        bits = 2 ** (k - 1) - 1
        rows = [np.ones(bits)]
        rows += [np.where((np.arange(bits) >> i) & 1, 1.0, -1.0) for i in range(k - 1)]
        return np.array(rows, np.float32)
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (k, bits)).astype(np.float32)
        if (np.abs(c.sum(0)) == k).any():
            continue
        distance = min(int((c[i] != c[i + 1:]).sum(1).min()) for i in range(k - 1))
        if distance > apart:
            best, apart = c, distance
    return best


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray      # languages x bits
    weights: np.ndarray    # (buckets + 1) x bits; the last row is zero
    trust: np.ndarray      # languages x bits, rows sum to 1

    def bits(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Classifier outputs: summed log-odds over the root of their number."""
        total = np.add.reduceat(self.weights[ids], off[:-1], axis=0)
        n = np.add.reduceat((ids < N_BUCKETS).astype(np.float32), off[:-1])
        return total / np.sqrt(np.maximum(n, 1))[:, None]

    def decode(self, f: np.ndarray) -> np.ndarray:
        """Probabilities from the weighted losses, rows x languages."""
        loss = np.stack([(np.logaddexp(0, -c * f) * t).sum(1) for c, t in zip(self.codes, self.trust, strict=True)], 1)
        x = -loss * self.codes.shape[1]
        p = np.exp(x - x.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _train_rows(docs: DataFrame, is_train: Column) -> DataFrame:
    return docs.where(is_train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def fit(docs: DataFrame, is_train: Column) -> Model:
    """Two passes over the training rows: counts by language and bucket, then
    each bit's accuracy by language."""
    rows = _train_rows(docs, is_train)
    counts_ddl = "lang string, bucket int, n bigint"

    def count(batches):
        schema, sums = arrow_schema(counts_ddl), {}
        for b in batches:
            codes = b["lang"].dictionary_encode()
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for a, z, ids, off in grams(b["text"]):
                row = np.repeat(at[a:z], np.diff(off))
                for i in np.unique(at[a:z]):
                    c = np.bincount(ids[row == i], minlength=N_BUCKETS + 1)
                    sums[names[i]] = sums.get(names[i], 0) + c
        for lang, c in sums.items():
            some = np.flatnonzero(c[:N_BUCKETS])
            yield batch(schema, lang=[lang] * len(some), bucket=some.astype(np.int32), n=c[some])

    table = rows.mapInArrow(count, counts_ddl).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = table.toPandas()  # at most N_BUCKETS numbers a language
    langs = sorted(found["lang"].unique())
    if not langs:
        return Model([], np.zeros((0, 1), np.float32), np.zeros((N_BUCKETS + 1, 1), np.float32), np.zeros((0, 1)))
    p = np.full((len(langs), N_BUCKETS), SMOOTHING)
    p[np.searchsorted(langs, found["lang"]), found["bucket"].to_numpy()] += found["n"].to_numpy()
    p /= p.sum(1, keepdims=True)
    codes = codewords(len(langs))
    weights = np.zeros((N_BUCKETS + 1, codes.shape[1]), np.float32)
    for i, c in enumerate(codes.T):
        if (c > 0).all():
            weights[:-1, i] = 1e-3
            continue
        weights[:-1, i] = np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0))
    model = Model(langs, codes, weights, np.full(codes.shape, 1 / codes.shape[1]))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    hits_ddl = "lang string, bit int, n bigint, hits bigint"

    def accuracy(batches):
        schema, m = arrow_schema(hits_ddl), shared.value
        hits, n = np.zeros(m.codes.shape, np.int64), np.zeros(len(m.langs), np.int64)
        for b in batches:
            at = np.searchsorted(m.langs, np.array(b["lang"].to_pylist(), object))
            for a, z, ids, off in grams(b["text"]):
                right = (np.sign(m.bits(ids, off)) == m.codes[at[a:z]])
                np.add.at(hits, at[a:z], right)
                np.add.at(n, at[a:z], 1)
        k = m.codes.shape[1]
        yield batch(schema, lang=np.repeat(np.array(m.langs, object), k).tolist(), bit=list(range(k)) * len(m.langs),
                    n=np.repeat(n, k), hits=hits.ravel())

    right = rows.mapInArrow(accuracy, hits_ddl).groupBy("lang", "bit").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits")).toPandas()
    trust = np.zeros(codes.shape)
    trust[np.searchsorted(langs, right["lang"]), right["bit"].to_numpy()] = (right["hits"] + 1) / (right["n"] + 2)
    model.trust = trust / trust.sum(1, keepdims=True)
    shared.destroy()
    return model


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, margin, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, *([] if "text" in keep else ["text"]))
    out = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add(
        "margin", "double").add("ambiguous", "boolean")
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()),
                        ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b["text"]
            letter = pc.match_substring_regex(texts.fill_null("").cast(pa.string()), r"\p{L}").to_numpy(zero_copy_only=False)
            n = b.num_rows
            lang, score, margin = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            if m.langs:
                for a, z, ids, off in grams(texts):
                    p = m.decode(m.bits(ids, off))
                    best = p.argmax(1)
                    top = np.sort(p, 1)
                    second = top[:, -2] if len(m.langs) > 1 else 0.0
                    lang[a:z], score[a:z], margin[a:z] = np.array(m.langs, object)[best], top[:, -1], top[:, -1] - second
            lang[~letter], score[~letter], margin[~letter] = "und", 0.0, 0.0
            found = batch(schema, lang_pred=lang.tolist(), score=score, margin=margin,
                          ambiguous=(margin < MIN_MARGIN) | (lang == "und"))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *found.columns], names=[*keep, *schema.names])

    return src.mapInArrow(run, out)


def keep_identified(docs: DataFrame, n_folds: int = 5) -> DataFrame:
    """``docs`` without texts that are ``und`` or ambiguous."""
    model = fit(docs, folds(F.col("doc_id"), n_folds) != 0)
    plain, back = shield(docs)
    return predict(plain, model, plain.columns).where(~F.col("ambiguous")).select(*back)


def identify(docs: DataFrame, n_folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, ambiguous of every document;
    learned from the rows of the folds other than 0."""
    fold = folds(F.col("doc_id"), n_folds)
    model = fit(docs, fold != 0)
    d = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    return predict(d, model, ["doc_id", "held_out"])

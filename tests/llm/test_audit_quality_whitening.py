"""Operators 11 to 13 against plain Python and numpy, and on odd rows."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from jobtrails.llm import filter_audit, whitening, zstd_quality
from tests.conftest import SF01
from tests.llm.conftest import rows_of, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11

def plain_audit(rows, labels):
    """Runs every order over the documents one by one."""
    texts = [(r[0], r[2] or "", r[1] or "") for r in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, _, t in texts:
        if d is not None:
            least[t] = min(least.get(t, d), d)
    fails = {
        "A": lambda d, t, w: len(w) < 200, "B": lambda d, t, w: 100 * len(set(w)) < 50 * len(w),
        "C": lambda d, t, w: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
        "D": lambda d, t, w: bool(re.search(r"[#$%&*|]", t)), "E": lambda d, t, w: d is not None and d > least[t]}
    by_part = {}
    for d, p, t in texts:
        w = WORD.findall(t)
        by_part.setdefault(p, []).append((d, {k for k, f in fails.items() if f(d, t, w)}))
    out = {}
    for part, docs in by_part.items():
        gone = Counter()
        for order in permutations("ABCDE"):
            left, failed = list(docs), []
            for step, k in enumerate(order, 1):
                removed = [x for x in left if k in x[1]]
                left = [x for x in left if k not in x[1]]
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(k in x[1] for x in failed), sum(x[1] == {k} for x in docs),
                    sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed)]
                gone[k] += len(removed)
                failed += removed
        for order in permutations("ABCDE"):
            for step, k in enumerate(order, 1):
                out[part, "".join(order), step].append(gone[k])
    return out


def audited(docs, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names]
            for r in filter_audit.audit(docs, labels).collect()}


def test_audit_of_odd_rows(spark, make, odd_rows):
    rng = random.Random(3)
    extra = []
    for i in range(60):
        w = words(rng, rng.choice([5, 199, 200, 260]))
        if i % 4 == 1:
            w = w[:9] * 40
        text = " ".join(w).upper() if i % 5 == 2 else " ".join(w) + " %" * (i % 6 == 3)
        extra.append((100 + i, extra[-1][1] if i % 7 == 6 else text, "EUROS"[i % 5] if i % 3 else None, *odd_rows[0][3:]))
    rows = odd_rows + extra + extra[:3]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 160, 2)] + [(100, None, 1), (None, 1, 1), (102, 1, None)]
    labels = [(d, q, int(t) if t is not None else None) for d, q, t in labels]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audited(make(rows=rows), frame)
    assert got == plain_audit(rows, labels)
    assert len({k[0] for k in got}) * 600 == len(got)


def test_audit_of_one_large_group_of_copies(spark, make):
    text = " ".join(words(random.Random(1), 300))
    got = audited(make([text] * 3000), spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert got["en", "EABCD", 1] == [1, 2999, 0, 2999, 0, 0, 120 * 2999]


def test_audit_of_empty_tables(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited(make(rows=[]), none) == {}
    assert audited(make([None]), none)["en", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_least_squares_gives_shapley_values(k):
    rng = random.Random(k)
    for _ in range(5):
        v = [0] + [rng.randint(0, 10**12) for _ in range((1 << k) - 1)]
        want = [Fraction(0)] * k
        for order in permutations(range(k)):
            s = 0
            for i in order:
                want[i] += Fraction(v[s | 1 << i] - v[s], factorial(k))
                s |= 1 << i
        assert filter_audit.shapley(v, k) == want


# ---------------------------------------------------------------- 12

def test_sizes_against_plain_compression(spark, make, odd_rows):
    rng = random.Random(2)
    good, bad = (zstd_quality.train([" ".join(words(rng, 200)).encode() for _ in range(n)], 4096) for n in (300, 2))
    got = zstd_quality.sizes(make(rows=odd_rows), ["doc_id"], good, bad).collect()
    c = [zstd_quality.compressor(x) for x in (good, bad)]
    want = []
    for r in odd_rows:
        t = (r[1] or "").encode()
        want.append((r[0], len(t), *(sum(len(x.compress(t[i:i + 1024])) for i in range(0, len(t), 1024)) for x in c)))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_quality_learns_only_from_its_folds(spark):
    """Scores stay when the held-out labels are turned round and other columns go; held-out accuracy."""
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    turned = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    bare = docs.withColumns({"lang": F.lit(None), "source": F.lit(None)})
    a = {r["doc_id"]: r for r in zstd_quality.score_quality(docs, labels).collect()}
    b = {r["doc_id"]: r for r in zstd_quality.score_quality(bare, turned).collect()}
    assert a == b and len(a) == docs.count()
    right = [a[r["doc_id"]]["predicted"] == r["quality"] for r in labels.collect() if a[r["doc_id"]]["held_out"]]
    assert sum(right) / len(right) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == (r["score"] >= 0.3) for d, r in a.items())


def test_quality_of_odd_rows(spark, make, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in zstd_quality.score_quality(make(rows=odd_rows), none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in zstd_quality.score_quality(make(rows=odd_rows), one).collect()} == {(1.0, 1)}
    rng = random.Random(4)
    texts = [" ".join(w + "###" * (i % 2) for w in words(rng, 150)) for i in range(80)]
    rows = rows_of(texts) + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in odd_rows]
    both = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)] * 2 + [(3, None, 1), (None, 0, 0)],
                                 "doc_id bigint, quality int, toxic int")
    got = zstd_quality.score_quality(make(rows=rows), both).collect()
    assert len(got) == len(rows)
    assert all(r["predicted"] == 1 - r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    assert len({r["score"] for r in got if not r["n_bytes"]}) == 1
    assert zstd_quality.score_quality(make(rows=[]), both).collect() == []


# ---------------------------------------------------------------- 13

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows],
                                 "vec_id bigint, embedding array<float>, x string, salt int, index int").repartition(3)


@pytest.mark.parametrize("per_block", [7, 8192])
def test_whitening_against_numpy(spark, per_block):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(150, 12)) * np.geomspace(3, .1, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(400)]
    rows += [(7, base[7].tolist()), (None, base[9].tolist()), (None, base[9].tolist())]
    odd = [(1, None), (2, []), (3, [1.0] * 11 + [nan]), (4, [None] * 12), (5, [1.0] * 13), (6, [inf] * 12),
           (8, [1e30] * 12)]
    got = whitening.whiten(vectors(spark, rows + odd), per_block=per_block).collect()
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    assert n == 150 and len(got) == 4 * len(rows)
    e, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    white = (x - s / n) @ q[:, :4] / np.sqrt(e[:4])
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9
    key = lambda r: (str(r[0]), *r[1:])
    for c in range(4):
        mine = [(r["vec_id"], int(r["deviation"]), r["whitened"]) for r in got if r["component"] == c + 1]
        sign = np.sign(sum(w for i, _, w in mine if i == 0) * white[0, c])
        want = [(i, int(d), sign * w) for (i, _), d, w in zip(rows, ((n * x - s) ** 2).sum(1), white[:, c])]
        for (i, d, w), (j, z, y) in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
            assert (i, d) == (j, z) and abs(w - y) < 1e-9


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [nan, 1.0])])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [-1.0, -0.0])])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9)), int(r["deviation"])) for r in got) == [
        (1, 1, 1.0, 512 ** 2), (2, 1, 1.0, 512 ** 2), (3, 1, 1.0, 512 ** 2)]


def test_whitening_query_returns_longs(spark):
    df = E.queries()["op13_whitening"](spark, SF01)
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("component", "n", "deviation", "whitened")] == ["int", "bigint", "bigint", "double"]
    assert df.where(F.col("deviation").isNull()).count() == 0

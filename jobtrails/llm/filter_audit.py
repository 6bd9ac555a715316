"""Filter interaction audit (operator 11).

Which filter removes what depends on the order the filters run in.  The audit
answers for all orders at once from one table: how many documents each of the
2^k coalitions of k filters removes, by part.

1. One pass over the texts gives every document a bit for each filter that it
   fails; the duplicate filter follows from narrow rows (a digest of the text,
   the smallest doc_id of each digest).
2. Documents are counted by (part, bits): at most 2^k rows a part.
3. For every part, the removals v(S) of all coalitions are tabulated.  The
   Shapley values are the solution of the weighted least squares

       minimise  sum over S of w(|S|) (v(S) - sum of phi_i, i in S)^2
       subject to  sum of all phi_i = v(all)

   with the kernel w(s) = (k - 1) / (C(k, s) s (k - s)), solved through its
   normal equations with a multiplier, in rationals, so that k! phi is a whole
   number without rounding.  The counts of a step are differences of v.

Results for odd rows: a null text is empty (no words: it fails A alone, and E
as a copy of other empty texts); a null lang is part ''; a null doc_id is
neither a copy nor an original; repeated rows of one doc_id count each, and
are no copies of each other; labels of several rows hold if any does.  An
empty table has no parts, hence no rows.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtrails.llm.common import arrow_schema, batch, materialise

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_UPPER_PCT = 3
SYMBOLS = b"#$%&*|"

_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_COUNTS = ["n", "good", "toxic"]


def text_bits(text: bytes, n_chars: int) -> int:
    """Bits of the four filters that look at one text."""
    words = text.split()  # ASCII white space, as bytes split
    n = len(words)
    return ((n < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PCT * n) << 1
            | (100 * len(text.translate(None, _NOT_UPPER)) > MAX_UPPER_PCT * n_chars) << 2
            | (len(text.translate(None, _NOT_SYMBOL)) > 0) << 3)


def failing(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, bits (filters A to D that the text fails) and text_key
    (SHA-256 of the text)."""
    d = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    ddl = "bits int, text_key binary"
    out = StructType(d.select("doc_id", "part").schema.fields + StructType.fromDDL(ddl).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for b in batches:
            text = b["text"].fill_null("")
            chars = pc.utf8_length(text).to_pylist()
            raw = [x.as_py() for x in pc.cast(text, pa.large_binary())]
            found = batch(schema, bits=[text_bits(t, n) for t, n in zip(raw, chars, strict=True)],
                          text_key=[hashlib.sha256(t).digest() for t in raw])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], *found.columns],
                                             names=["doc_id", "part", *schema.names])

    return d.mapInArrow(run, out)


def tabulate(found: DataFrame, labels: DataFrame, copy_bit: int = 4) -> DataFrame:
    """part, bits, n, good, toxic: documents by the filters they fail, the copy
    filter included.

    ``found`` is read twice.  Rows meet their labels by doc_id, which sorts
    apart the rows of one id; after that only counts move: a group of copies
    is a row for each (part, labels) that it has, however many documents."""
    truth = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    known = found.where(F.col("doc_id").isNotNull()).join(truth, "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["part", "bits", "good", "toxic"]
    ids = known.groupBy("doc_id", "text_key", *kind).agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("text_key", *kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("text_key"))
    groups = groups.withColumn("own", F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0)))
    split = groups.select("part", "good", "toxic", F.explode(F.array(
        F.struct("bits", F.col("own").alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(1 << copy_bit)).alias("bits"), (F.col("n") - F.col("own")).alias("n")))
    ).alias("z")).select("part", "good", "toxic", "z.bits", "z.n")
    nameless = found.where(F.col("doc_id").isNull()).groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "bits", "n")
    return split.unionByName(nameless).where(F.col("n") > 0).groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removals(counts: dict[int, int], k: int) -> list[int]:
    """v(S) for every coalition S: documents that fail any filter of S."""
    return [sum(n for bits, n in counts.items() if bits & s) for s in range(1 << k)]


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """x with a x = b for a regular matrix, by elimination in rationals."""
    m = [[*row, y] for row, y in zip(a, b, strict=True)]
    for i in range(len(m)):
        p = next(r for r in range(i, len(m)) if m[r][i])
        m[i], m[p] = m[p], m[i]
        m[i] = [x / m[i][i] for x in m[i]]
        for r in range(len(m)):
            if r != i and m[r][i]:
                f = m[r][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [row[-1] for row in m]


def shapley(v: list[int], k: int) -> list[Fraction]:
    """Shapley values of the game v by kernel-weighted least squares under the
    efficiency constraint: (X'WX, 1; 1', 0) (phi, l) = (X'Wv, v(all))."""
    if k == 1:
        return [Fraction(v[1])]
    gram = [[Fraction(0)] * (k + 1) for _ in range(k + 1)]
    right = [Fraction(0)] * k + [Fraction(v[-1])]
    for s in range(1, (1 << k) - 1):
        members = [i for i in range(k) if s >> i & 1]
        w = Fraction(k - 1, comb(k, len(members)) * len(members) * (k - len(members)))
        for i in members:
            right[i] += w * v[s]
            for j in members:
                gram[i][j] += w
    for i in range(k):
        gram[i][k] = gram[k][i] = Fraction(1)
    return solve(gram, right)[:k]


def steps(part: str, table: pd.DataFrame, names: str = FILTERS) -> pd.DataFrame:
    """A row for every order of the filters and every step of it."""
    k = len(names)
    bits = table["bits"].tolist()
    v = {c: removals(dict(zip(bits, table[c].tolist(), strict=True)), k) for c in _COUNTS}
    total, n = int(table["n"].sum()), v["n"]
    exact = [factorial(k) * x for x in shapley(n, k)]
    assert all(x.denominator == 1 for x in exact)
    rows = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = n[after] - n[before]
            rows.append((part, "".join(names[j] for j in order), step, total - n[after], gone, n[1 << i] - gone,
                         n[-1] - n[(1 << k) - 1 ^ 1 << i], v["good"][after] - v["good"][before],
                         v["toxic"][after] - v["toxic"][before], int(exact[i])))
            before = after
    return pd.DataFrame(rows, columns=[x.split()[0] for x in STEPS_DDL.split(", ")]).astype({"step": np.int32})


STEPS_DDL = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
             "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def interactions(table: DataFrame, names: str = FILTERS) -> DataFrame:
    """The steps of every order for each part of a table (part, bits, n, good,
    toxic); a part has at most 2^k rows, so its group is small."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return steps(key[0], rows, names)

    return table.groupBy("part").applyInPandas(run, STEPS_DDL)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Counts of all orders of the five filters over whole texts, by part."""
    found = materialise(failing(docs, part), "audit-bits")
    return interactions(tabulate(found, labels))

"""Title/state transition counting, smoothing and next-step prediction.

Plan shape: one hash shuffle on the sequence key (the window that pairs each
element with its successor), then a partially aggregated ``groupBy`` on the
pair -- the map-side combine means a hot pair never reaches one reducer as
raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrails.operators.sequences import by_size, range_row_number, topk_per_group


def successor_pairs(df: DataFrame, seq: str, order: Sequence[Column | str], symbol: str,
                    keep: Sequence[str] = (), dense_pos: str | None = None) -> DataFrame:
    """(symbol, next symbol) for each consecutive pair inside a sequence.

    A null symbol is a value like any other; only the last element of a
    sequence has no pair (``lead`` of a struct is null only there).

    With ``dense_pos`` (a 1..n position column defining the order), the
    successor is found by an equi-join on (sequence, position + 1) instead of
    a window: rows are hash-partitioned on both keys, so a sequence holding a
    large share of all rows is spread over every task.
    """
    if dense_pos is not None:
        cols = [symbol, *keep]
        a = df.select(seq, dense_pos, *cols)
        b = df.select(F.col(seq).alias("_s"), (F.col(dense_pos) - 1).alias("_p"),
                      F.struct(*[F.col(c) for c in cols]).alias("_nxt"))
        j = a.join(b, (a[seq] == b["_s"]) & (a[dense_pos] == b["_p"]))
        return j.select(a[seq], *[a[k] for k in keep], a[symbol].alias("title"),
                        F.col(f"_nxt.{symbol}").alias("next_title"),
                        *[F.col(f"_nxt.{k}").alias(f"next_{k}") for k in keep])
    w = Window.partitionBy(seq).orderBy(*order)
    nxt = F.lead(F.struct(*[F.col(c) for c in (symbol, *keep)])).over(w)
    out = df.select(seq, *keep, F.col(symbol), nxt.alias("_nxt"))
    return (out.where(F.col("_nxt").isNotNull())
               .select(seq, *keep, F.col(symbol).alias("title"),
                       F.col(f"_nxt.{symbol}").alias("next_title"),
                       *[F.col(f"_nxt.{k}").alias(f"next_{k}") for k in keep]))


def transition_counts(df: DataFrame, seq: str = "person_id",
                      order: Sequence[Column | str] | None = None,
                      symbol: str = "title", dense_pos: str | None = None,
                      skew_safe: bool = False) -> DataFrame:
    """Count of (title -> next title) over all sequences.

    Default order is the reference's: start year compared as text, then the
    title itself (both nulls first, as Python 2 sorts ``None`` lowest).

    ``skew_safe`` numbers very long sequences in that order with the
    range-partitioned ``range_row_number`` and pairs their neighbours by the
    dense-position equi-join, so no such sequence has to fit one task.
    """
    if order is None:
        order = [F.col("start_year").cast("string").asc_nulls_first(),
                 F.col(symbol).asc_nulls_first()]
    if skew_safe and dense_pos is None:
        pairs = by_size(df, seq, lambda d: successor_pairs(d, seq, order, symbol),
                        lambda d: successor_pairs(range_row_number(d, seq, order, "_rank"), seq, order, symbol,
                                                  dense_pos="_rank"))
    else:
        pairs = successor_pairs(df, seq, order, symbol, dense_pos=dense_pos)
    return pairs.groupBy("title", "next_title").agg(F.count(F.lit(1)).alias("n"))


def transition_probs(counts: DataFrame, num_states: int | Column | None = None,
                     gamma: float = 1.0, s1: str = "title", s2: str = "next_title",
                     n: str = "n") -> DataFrame:
    """(n_ij + g) / sum_k (n_ik + g) over *all* states k.

    Unseen pairs are not materialised (that would be a states x states
    product); each row instead carries ``prob_unseen`` = g / row total, the
    probability of any pair of that source state that never occurred.
    ``num_states`` defaults to the number of distinct states in ``counts``.
    """
    if num_states is None:
        num_states = (counts.select(F.col(s1).alias("s")).union(counts.select(F.col(s2)))
                      .agg(F.count_distinct("s").alias("k")).scalar())
    states = num_states if isinstance(num_states, Column) else F.lit(num_states)
    w = Window.partitionBy(s1)
    total = F.sum(F.col(n)).over(w) + states.cast("double") * F.lit(float(gamma))
    return counts.select(
        F.col(s1), F.col(s2), F.col(n),
        F.round((F.col(n) + F.lit(gamma)) / total, 6).alias("prob"),
        F.round(F.lit(gamma) / total, 6).alias("prob_unseen"),
    )


def next_title_top3(df: DataFrame, seq: str = "person_id", order: Sequence[Column | str] = ("pos",),
                    symbol: str = "title", k: int = 3, gamma: float = 1.0,
                    dense_pos: str | None = None) -> DataFrame:
    """Up to k most frequent successors of every title, with the smoothed
    transition probability; a title never seen with a successor gets one row
    with null prediction ("unseen").  Ties: count desc, then successor name.
    """
    counts = transition_counts(df, seq, list(order), symbol, dense_pos=dense_pos)
    asked = df.select(F.col(symbol).alias("title")).where(F.col("title").isNotNull()).distinct()
    num_states = (df.select(symbol).where(F.col(symbol).isNotNull())
                    .agg(F.count_distinct(symbol).alias("k")).scalar())
    probs = transition_probs(counts, num_states=num_states, gamma=gamma)
    top = topk_per_group(probs, "title", [F.col("n").desc(), F.col("next_title").asc_nulls_first()],
                         k, rank_col="rank")
    return (asked.join(top, "title", "left")
                 .select("title", "rank", "next_title", "n", "prob"))

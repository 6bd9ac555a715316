"""Descriptive statistics, histograms, vocabularies and sampler-trace
analytics (E3-E11, E13-E19).

Totals that a share divides by are scalar sub-queries (``DataFrame.scalar``)
-- a one-row aggregate with partial aggregation -- never a global window
over a table that grows with the data.  Ordered limits plan as
TakeOrderedAndProject (a per-task top-k, then one small merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrails.operators.sequences import range_row_number, range_running, topk_per_group

LABEL_OTHER = "* other *"
LABEL_MISSING = "* missing *"


def _count() -> Column:
    return F.count(F.lit(1))


def top_labels(df: DataFrame, labels: Sequence[str], n: int = 50) -> DataFrame:
    """The n most frequent label (tuples) with count and share of all rows.
    Ties: labels ascending."""
    counts = df.groupBy(*labels).agg(_count().alias("n"))
    total = counts.select(F.sum("n")).scalar()
    order = [F.col("n").desc()] + [F.col(c).asc_nulls_first() for c in labels]
    w = Window.orderBy(*order)
    top = counts.orderBy(*order).limit(n)
    # the window runs over the n-row result only
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), *labels, "n",
                      F.round(F.col("n") / total, 6).alias("share"))


def attr_histograms(df: DataFrame, key: str, attrs: Sequence[str], topn: int = 10) -> DataFrame:
    """Per attribute, value counts: the topn-1 most frequent values, the
    rest folded into "* other *", rows without the attribute as "* missing *".

    ``df`` has one row per element; an attribute is *missing* when the
    column is absent for that element, i.e. null in a ``_present`` struct
    field, and present-but-null values are counted as the value null.  For a
    flat table every attribute is present.
    """
    total = df.select(_count()).scalar()
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs
    ])).alias("kv")).select("kv.attr", "kv.value")
    counts = long.groupBy("attr", "value").agg(_count().alias("n"))
    # top values per attribute: a group-limited window (each task keeps its
    # top topn-1 per attribute before the shuffle), never a full ranking
    top = topk_per_group(counts, "attr", [F.col("n").desc(), F.col("value").asc_nulls_first()],
                         topn - 1, rank_col="_r").select("attr", "value", "n")
    present = counts.groupBy("attr").agg(F.sum("n").alias("_p"))
    kept = top.groupBy("attr").agg(F.sum("n").alias("_k"))
    other = (present.join(kept, "attr").where(F.col("_p") > F.col("_k"))
                    .select("attr", F.lit(LABEL_OTHER).alias("value"), (F.col("_p") - F.col("_k")).alias("n")))
    missing = (present.where(F.col("_p") < total)
                      .select("attr", F.lit(LABEL_MISSING).alias("value"),
                              (F.lit(total) - F.col("_p")).alias("n")))
    return (top.unionByName(other).unionByName(missing)
               .select("attr", "value", F.col("n").cast("bigint").alias("n")))


def element_histograms(rows: DataFrame, topn: int = 10) -> DataFrame:
    """E4 over counted (element, attr, value, n) rows, where each element has one
    with no attr: the topn-1 most frequent values of each attribute, the rest as
    "* other *", elements without the attribute as "* missing *"."""
    # counted once for the branches below: a filter in one of them would go
    # beneath the aggregate and make it a second pass over the rows
    counts = rows.groupBy("element", "attr", "value").agg(F.sum("n").alias("n")).checkpoint()
    total = counts.where(F.col("attr").isNull()).select("element", F.col("n").alias("_t"))
    counts = counts.where(F.col("attr").isNotNull())
    top = topk_per_group(counts, ["element", "attr"], [F.col("n").desc(), F.col("value").asc_nulls_first()],
                         topn - 1, rank_col="_r").select("element", "attr", "value", "n")
    present = counts.groupBy("element", "attr").agg(F.sum("n").alias("_p"))
    kept = top.groupBy("element", "attr").agg(F.sum("n").alias("_k"))
    other = (present.join(kept, ["element", "attr"]).where(F.col("_p") > F.col("_k"))
                    .select("element", "attr", F.lit(LABEL_OTHER).alias("value"), (F.col("_p") - F.col("_k")).alias("n")))
    missing = (present.join(total, "element").where(F.col("_p") < F.col("_t"))
                      .select("element", "attr", F.lit(LABEL_MISSING).alias("value"), (F.col("_t") - F.col("_p")).alias("n")))
    return (top.unionByName(other).unionByName(missing)
               .select("element", "attr", "value", F.col("n").cast("bigint").alias("n")))


def jobs_per_resume(jobs: DataFrame, person: str = "person_id", max_jobs: int = 21) -> DataFrame:
    """E5: number of jobs per person, keeping counts below ``max_jobs``."""
    return (jobs.groupBy(person).agg(_count().alias("n_jobs"))
                .where(F.col("n_jobs") < max_jobs))


def exact_median(df: DataFrame, col: str) -> Column:
    """Median (mid-point of the middle two) as a scalar sub-query: the distinct
    values are counted, sorted over ranges and summed up with carried totals, so
    no task holds them all; null for an empty column."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(_count().alias("_n"))
    d = range_running(counts.withColumn("_all", F.lit(0)), "_all", ["_value"], {"_before": F.col("_n")})
    total, first = F.col("_before_total"), F.col("_before")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < first + F.col("_n")), F.col("_value")))

    return d.agg(((at(F.floor((total - 1) / 2)).cast("double") + at(F.floor(total / 2)).cast("double")) / 2)
                 .alias("median")).scalar()


def count_stats(df: DataFrame, col: str, threshold: int = 0) -> DataFrame:
    """(mean, median, #above threshold, N) when threshold > 0, else
    (mean, median, min, max).  Median is exact (mid-point of the middle two)."""
    c = F.col(col)
    if threshold > 0:
        extra = [F.count_if(c > threshold).cast("bigint").alias("n_above"),
                 _count().cast("bigint").alias("n")]
    else:
        extra = [F.min(c).alias("min"), F.max(c).alias("max")]
    names = ["n_above", "n"] if threshold > 0 else ["min", "max"]
    return df.agg(F.round(F.avg(c), 6).alias("mean"), *extra).select(
        "mean", F.round(exact_median(df, col), 6).alias("median"), *names)


def salary_stats(people: DataFrame, currency: str = "USD", salary: str = "salary",
                 currency_col: str = "currency") -> DataFrame:
    """Statistics of salaries (truncated to int) in one currency."""
    s = (people.where((F.col(currency_col) == currency) & F.col(salary).isNotNull())
               .select(F.col(salary).cast("double").cast("bigint").alias("salary")))
    return count_stats(s, "salary", 0)


def currency_counts(people: DataFrame, currency_col: str = "currency") -> DataFrame:
    """Number of records per currency and its log10."""
    return (people.groupBy(currency_col).agg(_count().alias("n"))
                  .select(currency_col, "n", F.round(F.log10("n"), 6).alias("log10_n")))


def value_histogram(df: DataFrame, col: str, width: float, upper: float) -> DataFrame:
    """Equal-width bins (bin k covers [k*width, (k+1)*width)) of the
    values below ``upper``."""
    c = F.col(col)
    return (df.where(c < upper)
              .groupBy(F.floor(c / F.lit(width)).cast("bigint").alias("bin"))
              .agg(_count().alias("n")))


def value_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """E8 option: a reproducible random sample of n rows: the n smallest
    md5(key || seed) digests (a per-task top-n, then one small merge)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.orderBy(h, F.col(key)).limit(n)


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    """Count per label."""
    return df.groupBy(label).agg(_count().alias("n"))


def locations_by_size(df: DataFrame, loc: str = "location", pattern: str | None = None,
                      limit: int | None = None, extra_filter: Column | None = None) -> DataFrame:
    """Locations by frequency, optionally LIKE-filtered and limited."""
    d = df.where(F.col(loc).isNotNull())
    if extra_filter is not None:
        d = d.where(extra_filter)
    if pattern:
        d = d.where(F.col(loc).like(pattern))
    out = d.groupBy(loc).agg(_count().alias("n")).orderBy(F.col("n").desc(), F.col(loc).asc())
    return out.limit(limit) if limit else out


def max_id_where(df: DataFrame, key: str, cond: Column) -> DataFrame:
    """Max key under a condition."""
    return df.where(cond).agg(F.max(key).alias("max_id"))


# ---------------------------------------------------------------- sampler traces
def trace_mean(trace: DataFrame, keys: Sequence[str], value: str = "n", it: str = "iter",
               burn: int = 0, lag: int = 1) -> DataFrame:
    """Element-wise mean over kept iterations (index >= burn and index %
    lag == 0).  Cells absent in an iteration count as 0, so the divisor is the
    number of kept iterations, not the number of rows."""
    kept = trace.where((F.col(it) >= burn) & (F.col(it) % lag == 0))
    n_iter = kept.select(F.count_distinct(it)).scalar()
    return kept.groupBy(*keys).agg((F.sum(value) / n_iter).alias("mean"))


def trace_mode_state(states: DataFrame, doc: str, state: str) -> DataFrame:
    """Modal state per document over the kept iterations; ties -> smallest."""
    return states.groupBy(doc).agg(F.mode(state, True).alias("state"))


def top_transitions(means: DataFrame, s1: str = "s1", s2: str = "s2", value: str = "mean",
                    n: int = 101) -> DataFrame:
    """The strongest non-self transitions (value desc, then s1, s2 desc)."""
    order = [F.col(value).desc(), F.col(s1).desc(), F.col(s2).desc()]
    top = means.where(F.col(s1) != F.col(s2)).orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
                      s1, s2, F.round(value, 6).alias(value))


def state_mobility(means: DataFrame, s1: str = "s1", s2: str = "s2", value: str = "mean",
                   threshold: float = 0.5, n: int = 20) -> DataFrame:
    """Per state, how many target states (largest first, self excluded)
    it takes for the cumulative share of outgoing mass to exceed the
    threshold; the n most and n least mobile states.  A state with no
    outgoing mass gets null."""
    d = means.where(F.col(s1) != F.col(s2))
    d = range_running(d, s1, [F.col(value).desc(), F.col(s2).asc()], {"_before": F.col(value)})
    counts = (d.where(F.col("_before") <= F.col("_before_total") * threshold)
               .groupBy(s1).agg(F.when(F.max(F.col(value)) > 0, _count()).cast("bigint")
                                .alias("n_states")))
    most = counts.orderBy(F.col("n_states").desc_nulls_last(), F.col(s1).asc()).limit(n)
    least = counts.orderBy(F.col("n_states").asc_nulls_last(), F.col(s1).asc()).limit(n)
    wm = Window.orderBy(F.col("n_states").desc_nulls_last(), F.col(s1).asc())
    wl = Window.orderBy(F.col("n_states").asc_nulls_last(), F.col(s1).asc())
    return (most.select(F.lit("most").alias("kind"), F.row_number().over(wm).cast("bigint").alias("rank"),
                        F.col(s1).alias("state"), "n_states")
                .unionByName(least.select(F.lit("least").alias("kind"),
                                          F.row_number().over(wl).cast("bigint").alias("rank"),
                                          F.col(s1).alias("state"), "n_states")))


# ---------------------------------------------------------------- title vocabulary
def vocab_encode(counted: DataFrame, sequences: DataFrame, title: str = "title",
                 min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """Title vocabulary and encoded sequences.

    ``counted``: one row per counted title occurrence (all jobs of multi-job
    histories); ``sequences``: the kept title sequences.  Titles counted
    fewer than ``min_count`` times get id 0; other titles occurring in a kept
    sequence get 1..V (by count desc, then title); any other counted title 0.
    The dense numbering is a range-partitioned sort of the distinct titles.
    """
    counts = counted.groupBy(title).agg(_count().alias("count"))
    used = sequences.select(title).distinct().withColumn("_used", F.lit(True))
    v = counts.join(used, title, "left").checkpoint()  # for both kinds of titles, counted once
    frequent = (F.col("count") >= min_count) & F.col("_used").isNotNull()
    # numbered over a range-partitioned sort: the vocabulary is never in one task
    ranked = range_row_number(v.where(frequent).withColumn("_all", F.lit(0)), "_all",
                              [F.col("count").desc(), F.col(title).asc()], "id")
    vocab = (ranked.select(title, "count", "id")
                   .unionByName(v.where(~frequent).select(title, "count", F.lit(0).cast("bigint").alias("id"))))
    encoded = sequences.join(ranked.select(title, "id"), title, "left") \
                       .withColumn("id", F.coalesce(F.col("id"), F.lit(0).cast("bigint")))
    return vocab, encoded


def merge_counts(*counters: DataFrame, key: str = "title", n: str = "n") -> DataFrame:
    """Union of per-shard counters, summed by key."""
    u = counters[0]
    for c in counters[1:]:
        u = u.unionByName(c)
    return u.groupBy(key).agg(F.sum(n).cast("bigint").alias(n))

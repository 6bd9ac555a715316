"""Sequence and window operators.

A "sequence" is the long form ``(seq key, position, payload...)``; nested
arrays appear only at sinks.  Every window here is partitioned by the
sequence key, so one hash exchange serves all windows on the same key
(Spark reuses the child partitioning), and running frames (``ROWS UNBOUNDED
PRECEDING``) are evaluated incrementally -- never an O(n^2) per-row array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from jobtrails.functions import text as T
from jobtrails.session import shuffles_freed
from jobtrails.session import written as write_stage

#: rows of a sequence above which it is split over tasks
HOT_ROWS = 1_000_000
#: rows of whole sequences for one task, about, where windows sort them several times
TASK_ROWS = 250_000

_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def topk_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column],
                   k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group under a total order.

    ``row_number() <= k`` is planned as a window group limit, which trims
    each group to k rows *before* the shuffle, so a hot group costs k rows.
    """
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
              .where(F.col(rank_col) <= k))


def range_row_number(df: DataFrame, group: str, order: Sequence[Column | str],
                     out: str = "rn") -> DataFrame:
    """1-based row number within ``group`` under ``order``, computed without
    putting a group into one task.

    A global sort range-partitions the rows (sampled bounds split a hot group
    over many partitions); the sorted table is checkpointed so partition ids
    and ``monotonically_increasing_id`` are stable; then each (partition,
    group) run gets its offset from the counts of the same group in earlier
    partitions (a running sum over a table with one row per run).
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    srt = (df.orderBy(F.col(group), *order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id())
             .checkpoint())
    runs = srt.groupBy("_pid", group).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    j = srt.join(runs, ["_pid", group])
    return (j.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
             .drop("_pid", "_mid", "_first", "_n", "_off"))


def range_forward_fill(df: DataFrame, group: str, order: Sequence[Column | str],
                       fills: dict[str, Column], out_rank: str | None = None) -> DataFrame:
    """Carry the last non-null value of each ``fills`` expression forward in
    ``order`` within ``group`` (``last(x, ignorenulls)`` over a running
    frame), without putting a group into one task.

    Rows are globally sorted (range partitioning splits a hot group), the
    sort is checkpointed so partition ids are stable, values are filled
    within each (partition, group) run, and each run takes the last value
    carried out of the same group's earlier partitions from a summary table
    with one row per run.  ``out_rank`` also adds the row number in ``order``.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    base = df.select("*", *[c.alias(f"_v_{k}") for k, c in fills.items()])
    srt = (base.orderBy(F.col(group), *order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint())
    run = Window.partitionBy("_pid", group).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    for k in fills:
        srt = srt.withColumn(f"_l_{k}", F.last(f"_v_{k}", ignorenulls=True).over(run))
    aggs = [F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")]
    aggs += [F.max_by(F.col(f"_v_{k}"), F.when(F.col(f"_v_{k}").isNotNull(), F.col("_mid"))).alias(f"_o_{k}")
             for k in fills]
    runs = srt.groupBy("_pid", group).agg(*aggs)
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    for k in fills:
        runs = runs.withColumn(f"_c_{k}", F.last(f"_o_{k}", ignorenulls=True).over(before))
    j = srt.join(runs.select("_pid", group, "_first", "_off", *[f"_c_{k}" for k in fills]), ["_pid", group])
    for k in fills:
        j = j.withColumn(k, F.coalesce(F.col(f"_l_{k}"), F.col(f"_c_{k}")))
    if out_rank:
        j = j.withColumn(out_rank, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
    drop = ["_pid", "_mid", "_first", "_off"] + [f"_{p}_{k}" for k in fills for p in ("v", "l", "c")]
    return j.drop(*drop)


def range_running(df: DataFrame, group: str | Sequence[str], order: Sequence[Column | str],
                  sums: dict[str, Column], rank: str | None = None) -> DataFrame:
    """Weighted prefix sums: for each name in ``sums`` the sum of its expression
    over the rows of the group that stand before the row in ``order`` (0 at the
    start), and as ``<name>_total`` that over the whole group; ``rank`` also
    adds the row number.  No group has to fit one task.

    Rows are globally sorted (range partitioning splits a hot group) and
    checkpointed, so that partition ids are stable; sums run inside each
    (partition, group) run, and a table with a row for each run carries the
    totals of the runs before it.  A null group is a group.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    srt = (df.select("*", *[c.alias(f"_v_{k}") for k, c in sums.items()])
             .orderBy(*group, *order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id())
             .checkpoint())
    run = Window.partitionBy("_pid", *group).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    for k in sums:
        srt = srt.withColumn(f"_r_{k}", F.sum(f"_v_{k}").over(run))
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    runs = srt.groupBy(F.col("_pid").alias("_p"), *own).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    whole = Window.partitionBy(*[f"_g{i}" for i in range(len(group))])  # a row for each run
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_p", *[f"_g{i}" for i in range(len(group))], "_first",
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                       *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums],
                       *[F.sum(f"_s_{k}").over(whole).alias(f"{k}_total") for k in sums])
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    j = srt.join(runs, same)
    if rank:
        j = j.withColumn(rank, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
    return j.select(*df.columns, *([rank] if rank else []),
                    *[(F.coalesce(F.col(f"_r_{k}"), F.lit(0)) + F.col(f"_c_{k}")).alias(k) for k in sums],
                    *[f"{k}_total" for k in sums])


def by_size(df: DataFrame, seq: str, plain: Callable[[DataFrame], DataFrame],
            ranged: Callable[[DataFrame], DataFrame], written: bool = False) -> DataFrame:
    """``plain`` (windows by sequence: one shuffle) for the sequences of up to
    HOT_ROWS rows, ``ranged`` (sorted ranges: no sequence in one task) for the
    others; both give the same rows.  The input is written once, so that its
    plan runs once, unless it is ``written`` (read from files) already."""
    if not written:
        df = write_stage(df, "sequences")
    dealt = df
    hot = df.groupBy(seq).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select(seq)
    with shuffles_freed(df.sparkSession):
        parts, none = -(-df.count() // TASK_ROWS), hot.isEmpty()
    if parts > df.sparkSession.sparkContext.defaultParallelism:
        # the windows' shuffle, in pieces of a size that adaptive execution doesn't merge
        dealt = df.repartition(parts, seq)
    if none:
        return plain(dealt)
    hot = hot.checkpoint()
    few, many = (x.join(hot, seq, how).select(*df.columns) for x, how in ((dealt, "left_anti"), (df, "left_semi")))
    return plain(few).unionByName(ranged(many))


def stint_fill(df: DataFrame, person: str = "person_id", pos: str = "pos",
               start: str = "start_dt", end: str = "end_dt", skew_safe: bool = False,
               written: bool = False) -> DataFrame:
    """Repair missing stint dates within each person's history.

    Stints without any date are dropped; the rest are stably sorted by
    ``start or end``.  The first stint's missing start takes its end, the
    last stint's missing end takes its start.  Then, over the person's known
    dates (after those two fixes): a missing end becomes the smallest date
    after the start (else the start), a missing start the largest date before
    the end (else the end).  Output ``seq_pos`` is the new 1-based order.

    Position, ends and date lookups are windows over one shuffle by person.
    With ``skew_safe`` people of very many stints are left out of it: their
    first/last stint come from a per-person min/max aggregate, the date lookups
    run over the person's *distinct* dates (bounded by the calendar, not by the
    number of stints) and are joined back on (person, date), and the position is
    computed by ``range_row_number``.  ``written``: the stints are read from
    files, so they aren't written again.
    """
    if skew_safe:
        return by_size(df, person, lambda d: _stint_fill(d, person, pos, start, end, False),
                       lambda d: _stint_fill(d, person, pos, start, end, True), written)
    return _stint_fill(df, person, pos, start, end, False)


def _stint_fill(df: DataFrame, person: str, pos: str, start: str, end: str, ranged: bool) -> DataFrame:
    s, e = F.col(start), F.col(end)
    d = df.where(s.isNotNull() | e.isNotNull())
    d = d.withColumn("_key", F.struct(F.coalesce(s, e).alias("k"), F.col(pos).alias("p")))
    if ranged:
        ends = d.groupBy(person).agg(F.min("_key").alias("_kmin"), F.max("_key").alias("_kmax"))
        d = d.join(ends, person)
        first, last = F.col("_key") == F.col("_kmin"), F.col("_key") == F.col("_kmax")
    else:
        w = Window.partitionBy(person).orderBy("_key")
        d = (d.withColumn("seq_pos", F.row_number().over(w).cast("bigint"))
              .withColumn("_nextrow", F.lead(F.lit(1)).over(w)))
        first, last = F.col("seq_pos") == 1, F.col("_nextrow").isNull()
    d = d.withColumn("_s", F.when(first & s.isNull(), e).otherwise(s))
    d = d.withColumn("_e", F.when(last & e.isNull(), F.col("_s")).otherwise(e))
    # one lookup per stint: its start when the end is missing, its end when
    # the start is missing, else its own start (matched but unused) -- never a
    # null key, so complete stints do not pile up in one partition
    look = F.when(F.col("_s").isNull(), F.col("_e")).when(F.col("_e").isNull(), F.col("_s")).otherwise(F.col("_s"))
    d = d.withColumn("_look", look)
    if ranged or {df.schema[c].dataType for c in (start, end)} != {DateType()}:
        # the person's distinct known dates, each with its neighbours (a table
        # bounded by the calendar, not by the number of stints)
        dates = (d.select(person, F.explode(F.array("_s", "_e")).alias("_d")).where(F.col("_d").isNotNull())
                  .groupBy(person, "_d").agg(F.count(F.lit(1)).alias("_c")))
        wd = Window.partitionBy(person).orderBy("_d")
        dates = dates.select(F.col(person).alias("_lp"), "_d", F.lead("_d").over(wd).alias("_after"),
                             F.lag("_d").over(wd).alias("_before"))
        d = d.join(dates, (F.col(person) == F.col("_lp")) & (F.col("_look") == F.col("_d")), "left")
    else:
        d = _known_dates_around(d, person)
    new_end = F.when(F.col("_e").isNull(), F.coalesce(F.col("_after"), F.col("_s"))).otherwise(F.col("_e"))
    new_start = F.when(F.col("_s").isNull(), F.coalesce(F.col("_before"), F.col("_e"))).otherwise(F.col("_s"))
    keep = [c for c in df.columns if c not in (start, end)]
    if ranged:
        out = d.select(*keep, "_key", new_start.alias(start), new_end.alias(end))
        out = range_row_number(out, person, ["_key"], "seq_pos")
    else:
        out = d.select(*keep, "seq_pos", new_start.alias(start), new_end.alias(end))
    return out.select(*keep, "seq_pos", start, end)


def _known_dates_around(d: DataFrame, person: str) -> DataFrame:
    """``_after`` and ``_before``: the person's next known date after ``_look``
    and the last one before it.  A complete stint's end stands beside the stints
    as a row of its own; the dates then run in both directions over rows that
    are dealt by person already, so nothing is shuffled."""
    both = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    dates = F.when(both, F.array("_look", "_e")).otherwise(F.array("_look"))
    x = d.select(F.col(person), F.struct(*[c for c in d.columns if c != person]).alias("_row"),
                 F.posexplode(dates).alias("_k", "_d"))
    x = x.select(person, F.when(F.col("_k") == 0, F.col("_row")).alias("_row"), "_d", F.unix_date("_d").alias("_n"))
    w = Window.partitionBy(person)
    x = x.withColumn("_before", F.max("_d").over(w.orderBy("_n").rangeBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_after", F.min("_d").over(w.orderBy(F.col("_n").desc()).rangeBetween(Window.unboundedPreceding, -1)))
    known = F.col(person).isNotNull()  # no history is known by a null
    return x.where(F.col("_row").isNotNull()).select(person, "_row.*", *[F.when(known, F.col(c)).alias(c)
                                                                         for c in ("_before", "_after")])


def run_grouping(df: DataFrame, stream: str | None, order: Sequence[str], key: str) -> DataFrame:
    """Number the runs of consecutive equal ``key`` values (gaps and
    islands).  Each row gets ``run_no`` (1-based within its stream) and the
    order value of the run's first row.  Rows stay rows: a run is a key to
    group or join on, never a collected list.

    ``stream`` partitions the ordering (e.g. conversation); ``None`` treats
    the table as one stream, which is a single-task window -- only for an
    already small input.
    """
    w = (Window.partitionBy(stream) if stream else Window.partitionBy()).orderBy(*order)
    prev = F.lag(F.struct(F.col(key).alias("k"))).over(w)
    change = F.when(prev.isNull() | ~prev["k"].eqNullSafe(F.col(key)), 1).otherwise(0)
    out = df.withColumn("_chg", change)
    out = out.withColumn("run_no", F.sum("_chg").over(w.rowsBetween(*_RUNNING)).cast("bigint"))
    ws = Window.partitionBy(*( [stream] if stream else []), "run_no")
    return out.withColumn("run_start", F.min(order[-1]).over(ws)).drop("_chg")


def seq_flatten(nested: DataFrame, seq: str, items: str) -> tuple[DataFrame, DataFrame]:
    """Nested sequences -> (flat rows, lengths of the non-empty ones)."""
    flat = nested.select(seq, F.posexplode(items).alias("pos", "item"))
    lengths = flat.groupBy(seq).agg(F.count(F.lit(1)).alias("n"))
    return flat, lengths


def seq_unflatten(flat: DataFrame, seq: str, pos: str, item: str) -> DataFrame:
    """C4: flat rows -> one ordered array per sequence (a sink-side shape)."""
    return (flat.groupBy(seq)
                .agg(F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(item)))).alias("_s"))
                .select(seq, F.col(f"_s.{item}").alias("items")))


NULL_JOB = -1


def prev_next_links(df: DataFrame, seq: str = "person_id", pos: str = "pos",
                    job: str = "job_id", sentinel: int = NULL_JOB, dense: bool = False) -> DataFrame:
    """Previous and next job of every job in its sequence (sentinel at the ends).

    ``dense=True`` (positions are 1..n) finds both neighbours with
    equi-joins on (sequence, position -/+ 1) -- hash-partitioned on both
    keys, so one very long sequence does not land in a single task.
    """
    if dense:
        base = df.select(seq, pos, job)
        nb = df.select(F.col(seq).alias("_s"), F.col(pos).alias("_p"), F.col(job).alias("_j"))
        prev = base.join(nb, (base[seq] == nb["_s"]) & (base[pos] - 1 == nb["_p"]), "left") \
                   .select(base[seq], base[pos], base[job], F.col("_j").alias("prev_job"))
        nxt = nb.select(F.col("_s").alias("_s2"), F.col("_p").alias("_p2"), F.col("_j").alias("next_job"))
        out = prev.join(nxt, (prev[seq] == nxt["_s2"]) & (prev[pos] + 1 == nxt["_p2"]), "left")
        return out.select(seq, pos, job, F.coalesce("prev_job", F.lit(sentinel)).alias("prev_job"),
                          F.coalesce("next_job", F.lit(sentinel)).alias("next_job"))
    w = Window.partitionBy(seq).orderBy(pos)
    return df.select(seq, pos, job,
                     F.coalesce(F.lag(job).over(w), F.lit(sentinel)).alias("prev_job"),
                     F.coalesce(F.lead(job).over(w), F.lit(sentinel)).alias("next_job"))


def _carry_sequences(df: DataFrame, seq: str, pos: str, year: Column, value: Column,
                     present: Column, blank: Column | None, min_jobs: int = 2,
                     carry: bool = True, skew_safe: bool = False, written: bool = False) -> DataFrame:
    """Shared body of C6/C7: carry value and year forward in document order,
    stably sort by year, drop missing values, keep sequences of >= 2.

    ``skew_safe`` replaces, for histories of very many jobs, every window by
    range-partitioned forms (``range_forward_fill``, ``range_row_number``) and
    counts by aggregates joined back.  ``written``: the jobs are read from files."""
    if skew_safe:
        how = (seq, pos, year, value, present, blank, min_jobs, carry)
        return by_size(df, seq, lambda d: _carried(d, *how, ranged=False), lambda d: _carried(d, *how, ranged=True),
                       written)
    return _carried(df, seq, pos, year, value, present, blank, min_jobs, carry, ranged=False)


def _carried(df: DataFrame, seq: str, pos: str, year: Column, value: Column, present: Column, blank: Column | None,
             min_jobs: int, carry: bool, ranged: bool) -> DataFrame:
    keep = ["_v", "_y", "seq_pos", "seq_len"]
    present_value = F.col("_v").isNotNull()
    if blank is not None:
        present_value = present_value & ~blank
    if ranged:
        n_jobs = df.groupBy(seq).agg(F.count(F.lit(1)).alias("_n_jobs"))
        d = df.join(n_jobs, seq).where(F.col("_n_jobs") >= min_jobs)
        if carry:
            d = range_forward_fill(d, seq, [pos], {"_v": F.when(present, value), "_y": year})
            d = d.withColumn("_y", F.coalesce(F.col("_y"), F.lit(0)))
        else:
            d = d.withColumn("_v", F.when(present, value)).withColumn("_y", F.coalesce(year, F.lit(0)))
        d = d.where(present_value)
        d = range_row_number(d, seq, ["_y", pos], "seq_pos")
        lens = d.groupBy(seq).agg(F.count(F.lit(1)).cast("bigint").alias("seq_len"))
        return d.join(lens, seq).where(F.col("seq_len") >= 2).select(seq, *keep)
    w_doc = Window.partitionBy(seq).orderBy(pos)
    run = w_doc.rowsBetween(*_RUNNING)
    d = (df.withColumn("_n_jobs", F.count(F.lit(1)).over(Window.partitionBy(seq)))
           .where(F.col("_n_jobs") >= min_jobs)
           .withColumn("_v", F.last(F.when(present, value), ignorenulls=True).over(run)
                       if carry else F.when(present, value))
           .withColumn("_y", F.coalesce(F.last(year, ignorenulls=True).over(run), F.lit(0))
                       if carry else F.coalesce(year, F.lit(0))))
    d = d.where(present_value)
    w_year = Window.partitionBy(seq).orderBy("_y", pos)
    d = (d.withColumn("seq_pos", F.row_number().over(w_year).cast("bigint"))
          .withColumn("seq_len", F.count(F.lit(1)).over(Window.partitionBy(seq)).cast("bigint"))
          .where(F.col("seq_len") >= 2))
    return d.select(seq, *keep)


def title_sequences(df: DataFrame, seq: str = "person_id", pos: str = "pos",
                    year: str = "start_year", title: str = "title",
                    carry_forward: bool = True, skew_safe: bool = False, written: bool = False) -> DataFrame:
    """Cleaned title sequences of multi-job histories.

    A missing title (and a missing start year, initially 0) carries the
    previous job's value when ``carry_forward``; blank cleaned titles are
    dropped; output rows are ordered by (carried year, document position).
    """
    raw = F.col(title)
    present = raw.isNotNull() & (raw != "")
    cleaned = T.clean_title(raw)
    d = _carry_sequences(df, seq, pos, F.col(year), cleaned, present,
                         blank=(F.col("_v") == ""), carry=carry_forward, skew_safe=skew_safe, written=written)
    return d.select(seq, "seq_pos", F.col("_y").cast("bigint").alias("start_year"),
                    F.col("_v").alias("title"), "seq_len")


def desc_sequences(df: DataFrame, seq: str = "person_id", pos: str = "pos",
                   year: str | None = None, desc: str = "description",
                   skew_safe: bool = False) -> DataFrame:
    """Stop-word-free token lists of each job, carried forward like C6
    (an empty list is kept; only a missing description carries)."""
    raw = F.col(desc)
    y = F.col(year) if year else F.lit(None).cast("bigint")
    d = _carry_sequences(df, seq, pos, y, T.tokens_nostop(raw), raw.isNotNull(), blank=None,
                         skew_safe=skew_safe)
    return d.select(seq, "seq_pos", F.col("_v").alias("tokens"), "seq_len")


def length_histogram(lengths: DataFrame, n: str = "n", cap: int = 20) -> DataFrame:
    """Sequence-length histogram with every bucket 0..cap listed (the
    last bucket collects everything longer) and each bucket's share."""
    spark = lengths.sparkSession
    counts = (lengths.groupBy(F.least(F.col(n), F.lit(cap)).alias("length"))
                     .agg(F.count(F.lit(1)).alias("n_seqs")))
    buckets = spark.range(0, cap + 1).select(F.col("id").alias("length"))
    # the histogram has cap+1 rows, so the grand-total window is tiny
    h = buckets.join(counts, "length", "left").fillna(0, ["n_seqs"])
    total = F.sum("n_seqs").over(Window.partitionBy())
    return h.select("length", F.col("n_seqs").cast("bigint").alias("n_seqs"),
                    F.round(F.col("n_seqs") / total, 6).alias("share"))


def mass_cutoff(df: DataFrame, group: str, item: str, weight: str,
                threshold: float = 0.5) -> DataFrame:
    """Per group, items by weight desc (then item desc) kept until the
    cumulative share of the group's weight *exceeds* the threshold; the crossing
    item is kept.  Weights may be counts, which are summed exactly, or shares."""
    d = range_running(df, group, [F.col(weight).desc(), F.col(item).desc()], {"_before": F.col(weight)}, rank="rank")
    return d.where(F.col("_before") <= F.col("_before_total") * F.lit(threshold)).drop("_before", "_before_total")


def normalise(df: DataFrame, group: str, n: str, out: str = "weight") -> DataFrame:
    """Row-normalise counts within each group: totals by partial aggregation,
    joined back (one row for each group, so adaptive execution broadcasts them
    when they measure small)."""
    totals = df.groupBy(group).agg(F.sum(n).alias("_total"))
    return df.join(totals.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))) \
             .withColumn(out, F.col(n) / F.col("_total")).select(*[c for c in df.columns if c != out], out)

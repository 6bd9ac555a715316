"""Join operators.

* Fingerprint matching keys each history by an order-independent 128-bit
  multiset hash built with ``sum`` aggregates -- no per-person list is ever
  collected, so a huge history costs one partial aggregate, not one array.
* Co-worker and shared-employer totals are counted from running sums over a
  company's years or dates, without a pair.  The pair lists, for chosen people
  or companies, come from interval joins: each stint is replicated over the years it covers and
  joined to the stints that *start* in that year, so the join emits only
  candidate pairs that already overlap (work ~ output), and the hot
  (company, year) keys are split by AQE's skew-join handling.
* Dictionary sides (gazetteer, compound names, state tables) are joined
  normally; AQE turns them into broadcasts when their measured size is under
  the threshold.  Only the compound-name dictionary, bounded by its ``limit``,
  is broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrails.functions import location as LOC
from jobtrails.functions import text as TX
from jobtrails.operators.sequences import normalise, range_running


# ---------------------------------------------------------------- D1/D2 matching
def history_fingerprint(stints: DataFrame, seq: str, fields: Sequence[Column]) -> DataFrame:
    """Order-independent key of each history: (n, h1, h2), where h1/h2 sum
    two independently salted 64-bit hashes of each stint (as decimals, so
    the sums cannot overflow).  Equal multisets of stints give equal keys."""
    # the hash skips nulls: a flag for each field keeps (null, x) from (x, null)
    marked = [c for f in fields for c in (f.isNull(), f)]
    h1 = F.xxhash64(F.lit("fp1"), *marked).cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit("fp2"), *marked).cast("decimal(38,0)")
    return (stints.groupBy(seq)
                  .agg(F.count(F.lit(1)).alias("fp_n"), F.sum(h1).alias("fp_h1"),
                       F.sum(h2).alias("fp_h2")))


FP = ["fp_n", "fp_h1", "fp_h2"]


def match_by_fingerprint(table: DataFrame, probe: DataFrame, seq: str, pos: str,
                         table_fields: Sequence[Column], probe_fields: Sequence[Column],
                         job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Match probe histories to table histories with the same stints.

    On the table side the first history (lowest key) owns a fingerprint and
    the others are collisions; on the probe side each fingerprint is matched
    once (by its first probe history), later ones are misses.  Matched
    histories are zipped job by job on position.

    Returns (job matches (probe seq, pos, table seq, table job), counts
    (hits, misses, collisions)).
    """
    tk = history_fingerprint(table, seq, table_fields)
    owners = tk.groupBy(*FP).agg(F.min(seq).alias("table_seq"), F.count(F.lit(1)).alias("_n"))
    pk = history_fingerprint(probe, seq, probe_fields)
    firsts = pk.groupBy(*FP).agg(F.min(seq).alias("probe_seq"))
    pairs = firsts.join(owners, FP)
    jobs = (probe.select(F.col(seq).alias("probe_seq"), pos)
                 .join(pairs.select("probe_seq", "table_seq"), "probe_seq")
                 .join(table.select(F.col(seq).alias("table_seq"), pos, F.col(job).alias("table_job")),
                       ["table_seq", pos]))
    n_probe = pk.select(F.count(F.lit(1))).scalar()
    hits = pairs.select(F.count(F.lit(1))).scalar()
    collisions = owners.select(F.sum(F.col("_n") - 1)).scalar()
    counts = pairs.sparkSession.range(1).select(
        hits.cast("bigint").alias("hits"), (n_probe - hits).cast("bigint").alias("misses"),
        F.coalesce(collisions, F.lit(0)).cast("bigint").alias("collisions"))
    return jobs.select("probe_seq", pos, "table_seq", "table_job"), counts


def align_positional(left: DataFrame, right: DataFrame, seq: str, pos: str,
                     start: str, end: str, job: str = "job_id") -> DataFrame:
    """Pair two aligned streams of histories position by position.

    Histories of different lengths are ``bad_length`` (all their jobs);
    otherwise a job whose dates agree is ``match``, else ``bad_job``.
    """
    # both streams in one table, dealt by history once, instead of a join by (history, position)
    l, r = (df.select(seq, pos, F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(job).alias("j")).alias(tag))
            for df, tag in ((left, "l"), (right, "r")))
    x = l.withColumn("r", F.lit(None).cast(r.schema["r"].dataType)).unionByName(
        r.withColumn("l", F.lit(None).cast(l.schema["l"].dataType)))
    n = [F.count(c).over(Window.partitionBy(seq)) for c in ("l", "r")]
    x = x.withColumn("_same", n[0] == n[1])
    # a null key meets nothing: its group holds one side only
    alone = F.when(F.col(seq).isNull() | F.col(pos).isNull(), F.col("l").isNotNull())
    x = x.groupBy(seq, pos, alone.alias("_alone")).agg(
        F.max("_same").alias("_same"), F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
    for c in ("l", "r"):
        x = x.withColumn(c, F.explode_outer(c))
    dates_ok = F.col("l.s").eqNullSafe(F.col("r.s")) & F.col("l.e").eqNullSafe(F.col("r.e"))
    status = F.when(~F.col("_same"), "bad_length").when(dates_ok, "match").otherwise("bad_job")
    return x.select(seq, pos, F.col("l.j").alias("l_job"), F.col("r.j").alias("r_job"), status.alias("status"))


# ---------------------------------------------------------------- D3-D5 interval self-joins
def coworker_links(stints: DataFrame, person: str = "person_id", order: Sequence[str] = ("person_id", "pos"),
                   company: str = "company", start_year: str = "start_year",
                   end_year: str = "end_year") -> DataFrame:
    """D3: pairs of stints at the same company whose year ranges overlap.

    For stints i before j (row order): a missing start takes the end, both
    missing -> no link, a missing end -> no link; if s_i <= s_j the link
    needs s_j <= e_i, else s_i < e_j.  Output (id1, id2, company) with id1
    from the earlier row.

    Plan: the earlier-starting stint ``a`` is replicated over [s_a, e_a]
    and equi-joined on (company, year) to stints ``b`` starting that year.
    """
    s = F.coalesce(F.col(start_year), F.col(end_year))
    d = (stints.select(person, company, s.alias("_s"), F.col(end_year).alias("_e"),
                       F.struct(*[F.col(c) for c in order]).alias("_ord"))
               .where(F.col("_s").isNotNull()))
    # one explode gives both join sides: role 0 = the stint covering each
    # year of [s, e] (only a stint with an end year covers anything), role 1 =
    # the stint keyed on its start year.  Both sides come from the same
    # exchange of the stint table, which is therefore computed once; the join
    # strategy (sort-merge, or broadcast when one side is small) is AQE's.
    cover = F.when(F.col("_e").isNotNull() & (F.col("_e") >= F.col("_s")),
                   F.sequence(F.col("_s"), F.col("_e"))).otherwise(F.array().cast("array<int>"))
    keyed = F.concat(F.transform(cover, lambda y: F.struct(F.lit(0).alias("role"), y.cast("int").alias("_y"))),
                     F.array(F.struct(F.lit(1).alias("role"), F.col("_s").cast("int").alias("_y"))))
    x = (d.select(company, person, "_s", "_e", "_ord", F.explode(keyed).alias("k"))
          .select(company, person, "_s", "_e", "_ord", "k.role", "k._y"))
    a = x.where(F.col("role") == 0).select(F.col(company), F.col("_y"),
                                           *[F.col(c).alias(f"a{c}") for c in (person, "_s", "_e", "_ord")])
    b = x.where(F.col("role") == 1).select(F.col(company), F.col("_y"),
                                           *[F.col(c).alias(f"b{c}") for c in (person, "_s", "_e", "_ord")])
    j = a.join(b, [company, "_y"])
    # a precedes b in row order: the s_a <= s_b branch, found here once
    fwd = (F.col("a_ord") < F.col("b_ord")) & (F.col("a_s") <= F.col("b_s"))
    # b precedes a: then s_b > s_a and the link needs s_b < e_a
    bwd = (F.col("a_ord") > F.col("b_ord")) & (F.col("b_s") > F.col("a_s")) & (F.col("b_s") < F.col("a_e"))
    j = j.where(fwd | bwd)
    id1 = F.when(fwd, F.col(f"a{person}")).otherwise(F.col(f"b{person}"))
    id2 = F.when(fwd, F.col(f"b{person}")).otherwise(F.col(f"a{person}"))
    return j.select(id1.alias("id1"), id2.alias("id2"), F.col(company))


def _cover_parts(stints: DataFrame, person: str, order: Sequence[str], company: str, start_year: str,
                 end_year: str) -> tuple[DataFrame, DataFrame]:
    """What coworker_links would emit, counted without a pair.

    A stint a covers a stint b that starts strictly inside a's years, or in
    a's first or last year with b later in row order.  Strict covers follow
    from running totals over a company's years; the two touching years from
    running counts inside (company, year), split by ranges.

    Returns (company, _s, _e) groups with their size, the strict covers of one
    member (``inside``) and the strict covers that hold it (``around``); and
    one row for each stint and year it touches with ``covers`` and ``covered``.
    """
    s = F.coalesce(F.col(start_year), F.col(end_year))
    d = (stints.select(person, company, s.alias("_s"), F.col(end_year).alias("_e"),
                       F.struct(*[F.col(c) for c in order]).alias("_ord"))
               .where(F.col("_s").isNotNull() & F.col(company).isNotNull())
               .withColumn("_ok", F.coalesce(F.col("_e") >= F.col("_s"), F.lit(False))))
    groups = d.groupBy(company, "_s", "_e", "_ok").agg(F.count(F.lit(1)).alias("size"))

    # a company's years: starts, valid starts, valid ends and one-year stints
    n, ok = F.col("size"), F.col("_ok")
    years = groups.select(company, F.explode(F.array(
        F.struct(F.col("_s").alias("y"), n.alias("p"), F.when(ok, n).otherwise(0).alias("v"),
                 F.lit(0).cast("bigint").alias("x"), F.when(ok & (F.col("_s") == F.col("_e")), n).otherwise(0).alias("z")),
        F.struct(F.col("_e").alias("y"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("v"),
                 F.when(ok, n).otherwise(0).alias("x"), F.lit(0).cast("bigint").alias("z")))).alias("k")
    ).select(company, "k.*").where(F.col("y").isNotNull()).groupBy(company, "y").agg(
        *[F.sum(c).alias(c) for c in "pvxz"])
    to = Window.partitionBy(company).orderBy("y")
    years = years.select(company, "y", "p", "v", F.sum("p").over(to).alias("pp"), F.sum("v").over(to).alias("vv"),
                         F.sum("x").over(to).alias("xx"), "z")
    at_s = years.select(company, F.col("y").alias("_s"), F.col("pp").alias("P_s"), (F.col("vv") - F.col("v")).alias("V_s"),
                        F.col("xx").alias("X_s"), F.col("z").alias("z_s"))
    at_e = years.select(company, F.col("y").alias("_e"), (F.col("pp") - F.col("p")).alias("P_e"))
    groups = groups.join(at_s, [company, "_s"]).join(at_e, [company, "_e"], "left").select(
        company, "_s", "_e", "size",
        F.when(F.col("_ok"), F.greatest(F.col("P_e") - F.col("P_s"), F.lit(0))).otherwise(0).alias("inside"),
        (F.col("V_s") - F.col("X_s") + F.col("z_s")).alias("around"))

    # touching years: members start there, closers end there (and started before)
    touch = d.select(company, person, "_ord", "_ok", F.explode(F.array(
        F.struct(F.col("_s").alias("_y"), F.lit(1).alias("member")),
        F.struct(F.when(F.col("_ok") & (F.col("_e") > F.col("_s")), F.col("_e")).alias("_y"), F.lit(0).alias("member"))
    )).alias("k")).select(company, person, "_ord", "_ok", "k._y", "k.member").where(F.col("_y").isNotNull())
    # running counts over a range-partitioned sort: a company's year may span many tasks
    opens = F.when((F.col("member") == 0) | F.col("_ok"), 1).otherwise(0)
    touch = range_running(touch, [company, "_y"], ["_ord"], {"_members": F.col("member"), "_opens": opens})
    after = F.col("_members_total") - F.col("_members") - F.col("member")
    touch = touch.select(company, person, F.when(opens == 1, after).otherwise(0).alias("covers"),
                         F.when(F.col("member") == 1, F.col("_opens")).otherwise(0).alias("covered"))
    return groups, touch


def coworker_link_counts(stints: DataFrame, person: str = "person_id", order: Sequence[str] = ("person_id", "pos"),
                         company: str = "company", start_year: str = "start_year",
                         end_year: str = "end_year") -> DataFrame:
    """D3: number of co-worker links of each company that has one, from
    totals by year (work linear in the stints, see ``_cover_parts``)."""
    groups, touch = _cover_parts(stints, person, order, company, start_year, end_year)
    strict = groups.groupBy(company).agg(F.sum(F.col("size") * F.col("inside")).alias("n"))
    edge = touch.groupBy(company).agg(F.sum("covers").alias("n"))
    return (strict.union(edge).groupBy(company).agg(F.sum("n").cast("bigint").alias("n_links"))
            .where(F.col("n_links") > 0))


def coworker_person_counts(stints: DataFrame, person: str = "person_id", order: Sequence[str] = ("person_id", "pos"),
                           company: str = "company", start_year: str = "start_year",
                           end_year: str = "end_year") -> DataFrame:
    """Links of each person, both ends counted, without listing them."""
    groups, touch = _cover_parts(stints, person, order, company, start_year, end_year)
    own = stints.select(F.col(person), F.col(company), F.coalesce(F.col(start_year), F.col(end_year)).alias("_s"),
                        F.col(end_year).alias("_e")).groupBy(person, company, "_s", "_e").agg(
        F.count(F.lit(1)).alias("n"))
    g = groups.select(F.col(company).alias("_c"), F.col("_s").alias("_gs"), F.col("_e").alias("_ge"), "inside", "around")
    strict = own.join(g, (F.col(company) == F.col("_c")) & (F.col("_s") == F.col("_gs"))
                      & F.col("_e").eqNullSafe(F.col("_ge"))).groupBy(person).agg(
        F.sum(F.col("n") * (F.col("inside") + F.col("around"))).alias("degree"))
    edge = touch.groupBy(person).agg(F.sum(F.col("covers") + F.col("covered")).alias("degree"))
    return strict.union(edge).groupBy(F.col(person).alias("person_id")).agg(
        F.sum("degree").cast("bigint").alias("degree")).where(F.col("degree") > 0)


def coworker_degree(degrees: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` people with most links (ties: id asc)."""
    order = [F.col("degree").desc(), F.col("person_id").asc()]
    top = degrees.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
                      "person_id", "degree")


def merged_stints(stints: DataFrame, person: str, company: str, start: str, end: str) -> DataFrame:
    """Each person's strictly overlapping stints at a company as one interval."""
    d = stints.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(company).isNotNull()
                     & (F.col(end) >= F.col(start)))
    w = Window.partitionBy(person, company).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a gap starts where nothing before reaches beyond the start
    d = d.withColumn("_new", F.when(reach > F.col(start), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(person, company, "_run").agg(F.min(start).alias("_s"), F.max(end).alias("_e")).drop("_run")


def shared_employer_counts(stints: DataFrame, person: str = "person_id", company: str = "company",
                           start: str = "start_dt", end: str = "end_dt") -> DataFrame:
    """D5 by company: people, their merged intervals and the number of
    strictly overlapping pairs of intervals, without listing them: of all
    pairs, those where one ends no later than the other starts are left out,
    counted from running totals over the company's dates."""
    m = merged_stints(stints, person, company, start, end)
    one = (F.col("_s") == F.col("_e")).cast("bigint")
    dates = m.select(company, F.explode(F.array(
        F.struct(F.col("_s").alias("d"), F.lit(1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e"),
                 one.alias("z")),
        F.struct(F.col("_e").alias("d"), F.lit(0).cast("bigint").alias("s"), F.lit(1).cast("bigint").alias("e"),
                 F.lit(0).cast("bigint").alias("z")))).alias("k")).select(company, "k.*").groupBy(company, "d").agg(
        *[F.sum(c).alias(c) for c in "sez"])
    ended = F.sum("e").over(Window.partitionBy(company).orderBy("d"))
    # a one-day interval ends at its own start; two on one day are apart both ways
    apart = dates.withColumn("n", F.col("s") * ended - F.col("z") - F.col("z") * (F.col("z") - 1) / 2)
    apart = apart.groupBy(company).agg(F.sum("n").alias("apart"), F.sum("s").alias("k"))
    people = m.groupBy(company).agg(F.count_distinct(person).alias("n_people"))
    return apart.join(people, company).select(
        company, "n_people", F.col("k").cast("bigint").alias("n_intervals"),
        (F.col("k") * (F.col("k") - 1) / 2 - F.col("apart")).cast("bigint").alias("n_overlaps"))


def shared_employers(stints: DataFrame, person: str = "person_id", company: str = "company",
                     start: str = "start_dt", end: str = "end_dt", exclude_dups: bool = False,
                     people: DataFrame | None = None) -> DataFrame:
    """D5 for a chosen part of the stints (some people or companies; the pairs
    grow with the square of a company, see ``shared_employer_counts`` for all):
    per pair of people, the companies where they held strictly
    overlapping stints (s2 < e1 and s1 < e2); optionally skip pairs whose
    whole company sets are equal.  Output (person1 < person2, company).
    With ``people`` (one column, the person's key) only the pairs that hold one
    of them: no other pair is made on the way."""
    d = stints.where(F.col(start).isNotNull() & F.col(end).isNotNull()) \
              .select(person, company, start, end)
    if people is None:
        d = d.withColumn("_mine", F.lit(True))
    else:
        people = people.select(person).distinct()
        # only the companies of these people, and these stints once for both sides
        d = d.join(d.join(people, person, "left_semi").select(company).distinct(), company, "left_semi")
        d = d.join(people.withColumn("_mine", F.lit(True)), person, "left")
        d = d.withColumn("_mine", F.coalesce("_mine", F.lit(False))).checkpoint()
    # month buckets: the later-starting stint's start month lies in the
    # earlier one's [start month, end month] whenever they overlap.  As in
    # coworker_links, one role-tagged explode feeds both sides.
    ms = F.trunc(F.col(start), "month")
    me = F.greatest(ms, F.trunc(F.col(end), "month"))
    keyed = F.concat(
        F.transform(F.sequence(ms, me, F.expr("interval 1 month")),
                    lambda m: F.struct(F.lit(0).alias("role"), m.alias("_y"))),
        F.array(F.struct(F.lit(1).alias("role"), ms.alias("_y"))))
    cols = (person, start, end, "_mine")
    x = d.select(company, *cols, F.explode(keyed).alias("k")).select(company, *cols, "k.role", "k._y")
    a = x.where(F.col("role") == 0).select(company, "_y", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = x.where(F.col("role") == 1).select(company, "_y", *[F.col(c).alias(f"b_{c}") for c in cols])
    j = a.where("a__mine").join(b, [company, "_y"])
    if people is not None:
        j = j.unionByName(a.where("not a__mine").join(b.where("b__mine"), [company, "_y"]))
    sa, ea, sb, eb = (F.col(f"a_{start}"), F.col(f"a_{end}"), F.col(f"b_{start}"), F.col(f"b_{end}"))
    pa, pb = F.col(f"a_{person}"), F.col(f"b_{person}")
    # b is the later-starting stint (ties broken by person), strictly inside a's span
    later = (sa < sb) | ((sa == sb) & (pa < pb))
    j = j.where(later & (sb < ea) & (sa < eb) & (pa != pb))
    # dealt by pair, so that what is counted for each pair next needs no other shuffle
    out = j.select(F.least(pa, pb).alias("person1"), F.greatest(pa, pb).alias("person2"),
                   F.col(company)).repartition("person1", "person2").distinct()
    if exclude_dups:
        sets = (stints.select(person, company).distinct()
                      .groupBy(person).agg(F.count(F.lit(1)).alias("_n"),
                                           F.sum(F.xxhash64(F.col(company).isNull(), F.col(company)).cast("decimal(38,0)")).alias("_h")))
        s1 = sets.select(F.col(person).alias("person1"), F.col("_n").alias("_n1"), F.col("_h").alias("_h1"))
        s2 = sets.select(F.col(person).alias("person2"), F.col("_n").alias("_n2"), F.col("_h").alias("_h2"))
        out = (out.join(s1, "person1").join(s2, "person2")
                  .where(~((F.col("_n1") == F.col("_n2")) & (F.col("_h1") == F.col("_h2"))))
                  .select("person1", "person2", company))
    return out


def shared_employer_links(pairs: DataFrame) -> DataFrame:
    """Of each person in the rows of ``shared_employers``: the people they
    share an employer with, and the links to them (one a company)."""
    per_pair = pairs.groupBy("person1", "person2").agg(F.count(F.lit(1)).alias("n"))
    return (per_pair.select(F.explode(F.array("person1", "person2")).alias("person_id"), "n")
                    .groupBy("person_id").agg(F.count(F.lit(1)).alias("n_partners"), F.sum("n").alias("n_links")))


# ---------------------------------------------------------------- D6/D7 locations
def compound_dictionary(locs: DataFrame, loc: str = "location", limit: int = 20000) -> DataFrame:
    """D7 dictionary: from the ``limit`` most frequent locations of three or
    more words, squished first two tokens -> "first second".  When several
    share a squished key, the last in (count desc, location asc) order wins,
    as a later dictionary write would."""
    top = (locs.where(F.col(loc).like("% % %"))
               .groupBy(loc).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.col("n").desc(), F.col(loc).asc()).limit(limit))
    toks = TX.whitespace_tokens(F.lower(TX.strip_ws(F.col(loc))))
    d = top.select("n", F.col(loc), toks.alias("_t")).where(F.size("_t") >= 2)
    t1, t2 = F.try_element_at(F.col("_t"), F.lit(1)), F.try_element_at(F.col("_t"), F.lit(2))
    d = d.select("n", F.col(loc), F.concat(t1, t2).alias("squished"),
                 F.concat_ws(" ", t1, t2).alias("unsquished"))
    w = Window.partitionBy("squished").orderBy(F.col("n").asc(), F.col(loc).desc())
    return (d.withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select("squished", "unsquished"))


def compound_place_fix(locs: DataFrame, dictionary: DataFrame, loc: str = "location") -> DataFrame:
    """Rewrite a location whose first token is a squished compound name;
    the rewritten string is geocoder-preprocessed, others get null."""
    toks = TX.whitespace_tokens(F.lower(TX.strip_ws(F.col(loc))))
    d = locs.withColumn("_t", toks).withColumn("_first", F.try_element_at(F.col("_t"), F.lit(1)))
    # the dictionary holds at most ``limit`` rows, so broadcasting it is bounded
    j = d.join(F.broadcast(dictionary), d["_first"] == dictionary["squished"], "left")
    rest = F.slice(F.col("_t"), 2, F.greatest(F.size("_t") - 1, F.lit(0)))
    fixed = F.concat_ws(" ", F.col("unsquished"), F.array_join(rest, " "))
    fixed = F.when(F.size(rest) == 0, F.col("unsquished")).otherwise(fixed)
    return j.select(*locs.columns, F.when(F.col("unsquished").isNotNull(),
                                          LOC.preprocess_loc(fixed)).alias("compound_fix"))


def gazetteer_geocode(locs: DataFrame, gazetteer: DataFrame,
                      fallbacks: Sequence[Callable[[Column], Column]] = (),
                      loc: str = "location", key: str = "key") -> DataFrame:
    """Geocode each *distinct* location against a gazetteer keyed by the
    preprocessed query string, trying the fall-back rewrites in order, then
    fan the result out to every row with that location (a set-based update).

    ``matched_by`` is 0 for a direct hit, k for the k-th fall-back, null for
    a miss.
    """
    distinct = locs.where(F.col(loc).isNotNull()).select(loc).distinct()
    keys = [LOC.preprocess_loc(F.col(loc))] + [LOC.preprocess_loc(f(F.col(loc))) for f in fallbacks]
    g_cols = [c for c in gazetteer.columns if c != key]
    d = distinct
    for i, k in enumerate(keys):
        g = gazetteer.select(F.col(key).alias(f"_k{i}"),
                             F.struct(*[F.col(c) for c in g_cols]).alias(f"_g{i}"))
        d = d.withColumn(f"_k{i}", k).join(g, f"_k{i}", "left")
    hit = F.coalesce(*[F.col(f"_g{i}") for i in range(len(keys))])
    by = F.coalesce(*[F.when(F.col(f"_g{i}").isNotNull(), F.lit(i)) for i in range(len(keys))])
    geo = d.select(loc, hit.alias("_geo"), by.alias("matched_by"))
    return (locs.join(geo, loc, "left")
                .select(*locs.columns, *[F.col(f"_geo.{c}").alias(c) for c in g_cols], "matched_by"))


def upsert_attrs(target: DataFrame, updates: DataFrame, keys: Sequence[str],
                 attrs: Sequence[str]) -> DataFrame:
    """Set-based UPDATE -- rows whose keys match an update row (null
    matches null) take its attribute values; the others keep theirs.
    ``updates`` holds one row per key."""
    u = updates.select(*[F.col(k).alias(f"_u_{k}") for k in keys],
                       *[F.col(a).alias(f"_u_{a}") for a in attrs], F.lit(True).alias("_u_hit"))
    cond = None
    for k in keys:
        c = target[k].eqNullSafe(u[f"_u_{k}"])
        cond = c if cond is None else cond & c
    j = target.join(u, cond, "left")
    hit = F.coalesce(F.col("_u_hit"), F.lit(False))
    return j.select(*[F.when(hit, F.col(f"_u_{c}")).otherwise(target[c]).alias(c) if c in attrs
                      else target[c] for c in target.columns])


# ---------------------------------------------------------------- D9-D11
def job_transition_probs(jobs: DataFrame, probs: DataFrame, seq: str = "person_id", pos: str = "pos",
                         job: str = "job_id", state: str = "state") -> DataFrame:
    """Each consecutive job pair -> (job1, job2, state1, state2, prob),
    with the smoothed probability of the state pair (``probs`` carries
    title/next_title/prob/prob_unseen, see ``transition_probs``)."""
    w = Window.partitionBy(seq).orderBy(pos)
    nxt = F.lead(F.struct(F.col(job).alias("j"), F.col(state).alias("s"))).over(w)
    pairs = (jobs.select(F.col(job).alias("job_id1"), F.col(state).alias("state1"), nxt.alias("_n"))
                 .where(F.col("_n").isNotNull())
                 .select("job_id1", F.col("_n.j").alias("job_id2"), "state1", F.col("_n.s").alias("state2")))
    seen = probs.select(F.col("title").alias("state1"), F.col("next_title").alias("state2"), "prob")
    unseen = probs.select(F.col("title").alias("state1"), "prob_unseen").distinct()
    return (pairs.join(seen, ["state1", "state2"], "left")
                 .join(unseen, "state1", "left")
                 .select("job_id1", "job_id2", "state1", "state2",
                         F.coalesce(F.col("prob"), F.col("prob_unseen")).alias("trans_prob")))


def state_word_mix(state_topics: DataFrame, topic_words: DataFrame, n_words: int = 10,
                   words_per_topic: int = 500) -> DataFrame:
    """score(word | state) = sum over topics of share(topic in state) *
    freq(word in topic), using each topic's top ``words_per_topic`` words;
    the top ``n_words`` words per state.

    ``state_topics``: (state, topic, mass); ``topic_words``: (topic, word, weight).
    """
    share = normalise(state_topics, "state", "mass", out="share")
    wt = Window.partitionBy("topic").orderBy(F.col("weight").desc(), F.col("word").desc())
    tw = topic_words.withColumn("_r", F.row_number().over(wt)).where(F.col("_r") <= words_per_topic)
    scores = (share.join(tw, "topic")
                   .groupBy("state", "word").agg(F.sum(F.col("share") * F.col("weight")).alias("score")))
    ws = Window.partitionBy("state").orderBy(F.col("score").desc(), F.col("word").asc())
    return (scores.withColumn("rank", F.row_number().over(ws).cast("bigint"))
                  .where(F.col("rank") <= n_words)
                  .select("state", "rank", "word", F.round("score", 6).alias("score")))


def unseen_anti(heldout: DataFrame, vocab: DataFrame, title: str = "title") -> DataFrame:
    """Held-out titles that have no vocabulary entry (they encode as 0)."""
    return heldout.select(title).distinct().join(vocab.select(title), title, "left_anti")

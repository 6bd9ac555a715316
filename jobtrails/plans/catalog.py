"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, wired to the adapter views.

Every query reads the driver tables (through the views), so its work grows
with them.  Output columns are aliased and typed to match the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrails.functions import dates as DT
from jobtrails.functions import location as LOC
from jobtrails.functions import text as TX
from jobtrails.operators import gibbs as GB
from jobtrails.operators import hmm as HM
from jobtrails.operators import joins as JN
from jobtrails.operators import sequences as SQ
from jobtrails.operators import stats as ST
from jobtrails.operators import text as TXT
from jobtrails.operators import topics as TOP
from jobtrails.operators import transitions as TR
from jobtrails.session import checkpoint_dir
from jobtrails.session import stage_path
from jobtrails.session import written as _kept
from jobtrails.sources import resume_xml as RX
from jobtrails.sources import sequences_io as SIO
from jobtrails.sources import splits as SP
from jobtrails.sources import tables as V
from jobtrails.sources import xml_tags as XT
from jobtrails.sources.gazetteer import gazetteer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str) -> V.Tables:
    # every query may checkpoint or stage a table: make sure the session's
    # shared checkpoint folder is known to the SparkContext
    checkpoint_dir(spark)
    return V.Tables(spark, sf_dir)


# ---------------------------------------------------------------- E1, E2, E12
@query("transition_counts")
def q_transition_counts(spark, sf_dir):
    return TR.transition_counts(V.titles_v(_t(spark, sf_dir)), skew_safe=True)


@query("transition_probs")
def q_transition_probs(spark, sf_dir):
    ev = V.events_v(_t(spark, sf_dir))
    counts = TR.transition_counts(ev, order=["pos"])
    k = ev.where(F.col("title").isNotNull()).agg(F.count_distinct("title").alias("k")).scalar()
    return TR.transition_probs(counts, num_states=k)


@query("next_title_top3")
def q_next_title_top3(spark, sf_dir):
    return TR.next_title_top3(V.events_v(_t(spark, sf_dir)))


#: share of the people (by hash) that models are fitted on
TRAIN_PCT = 80

# Queries checked by invariants (tests) rather than by an SQL oracle:
# iterative or randomised models.
ROWS_ONLY: set[str] = {"lda_topics", "lda_topic_words", "lda_transform_heldout", "hmm_fit_em",
                       "hmm_score", "hmm_decode_next", "hmm_topics_next", "gibbs_hmm_fit",
                       "gibbs_resume"}


# ---------------------------------------------------------------- B: scalar functions


def _fingerprint(tokens) -> list:
    """Token count and digest of a whole token list (order-sensitive)."""
    return [F.size(tokens).cast("bigint").alias("n_tokens"),
            F.md5(F.array_join(tokens, " ")).alias("tokens_md5")]


@query("clean_name")
def q_clean_name(spark, sf_dir):
    p = V.pages_v(_t(spark, sf_dir))
    return p.select("page_id", TX.clean_name(F.col("html")).alias("clean_html"),
                    TX.clean_name(F.col("url")).alias("clean_url"))


@query("company_key")
def q_company_key(spark, sf_dir):
    j = V.jobs_v(_t(spark, sf_dir))
    loc = F.when(F.col("pos") % 4 == 0, F.lit(" \t")).otherwise(F.col("location"))
    key = TX.company_key(F.col("company"), loc)
    j = j.select("job_id", key.alias("company_key"))
    company, location = TX.split_company_key(F.col("company_key"))
    return j.select("job_id", "company_key", company.alias("company"), location.alias("location"))


@query("make_month_date")
def q_make_month_date(spark, sf_dir):
    j = V.jobs_v(_t(spark, sf_dir))
    y = F.when(F.col("pos") % 3 == 0, F.year("start_dt") - 1900).otherwise(F.year("start_dt"))
    m = (F.month("start_dt") + F.col("pos")) % 14
    return j.select("job_id", DT.make_month_date(y.cast("string"), m.cast("string")).alias("d"))


@query("clean_title")
def q_clean_title(spark, sf_dir):
    t = V.titles_v(_t(spark, sf_dir))
    return t.select("person_id", "pos", TX.clean_title(F.col("title")).alias("clean"),
                    TX.clean_title_loose(F.col("title")).alias("clean_loose"))


@query("stint_years")
def q_stint_years(spark, sf_dir):
    j = V.jobs_v(_t(spark, sf_dir)).where(F.col("start_dt").isNotNull() & F.col("end_dt").isNotNull())
    s, e = F.col("start_dt"), F.col("end_dt")
    return j.select("job_id", F.round(DT.stint_years(s, e), 6).alias("years"),
                    DT.stint_years_text(s, e).alias("years_text"))


@query("tokens_wordpunct")
def q_tokens_wordpunct(spark, sf_dir):
    d = V.docs_v(_t(spark, sf_dir))
    return d.select("job_id", *_fingerprint(TX.tokens_wordpunct(F.col("description"))))


@query("tokens_nostop_alpha")
def q_tokens_nostop_alpha(spark, sf_dir):
    d = V.docs_v(_t(spark, sf_dir))
    return d.select("job_id", *_fingerprint(TX.tokens_nostop_alpha(F.col("description"))))


@query("tokens_nostop")
def q_tokens_nostop(spark, sf_dir):
    d = V.docs_v(_t(spark, sf_dir))
    return d.select("job_id", *_fingerprint(TX.tokens_nostop(F.col("description"))))


@query("preprocess_loc")
def q_preprocess_loc(spark, sf_dir):
    l = V.locs_v(_t(spark, sf_dir))
    pre = LOC.preprocess_loc(F.col("location"))
    return l.select("job_id", pre.alias("query"),
                    LOC.unconcat_state(F.col("location")).alias("unconcat"),
                    LOC.strip_country(pre).alias("stripped"))


@query("address_parts")
def q_address_parts(spark, sf_dir):
    a = V.addr_v(_t(spark, sf_dir))
    return a.select("job_id", LOC.address_parts(F.col("address")).alias("p")).select("job_id", "p.*")


@query("where_like")
def q_where_like(spark, sf_dir):
    l = V.locs_v(_t(spark, sf_dir))
    return l.where(F.col("location").isNotNull() & F.col("location").like("% % %")) \
            .select("job_id", "location")


@query("standardize_location")
def q_standardize_location(spark, sf_dir):
    l = V.locs_v(_t(spark, sf_dir)).where(F.col("location").isNotNull())
    return l.select("job_id", LOC.standardize_location(F.col("location")).alias("s")) \
            .select("job_id", "s.*")


# ---------------------------------------------------------------- C: sequences and windows
@query("stint_fill")
def q_stint_fill(spark, sf_dir):
    return SQ.stint_fill(V.jobs_v(_t(spark, sf_dir)), skew_safe=True)


@query("run_grouping")
def q_run_grouping(spark, sf_dir):
    c = V.conv_v(_t(spark, sf_dir))
    return SQ.run_grouping(c, "conv_id", ["turn"], "role")


def _doc_tokens(spark, sf_dir):
    d = V.docs_v(_t(spark, sf_dir))
    return d.select("job_id", TX.tokens_nostop(F.col("description")).alias("tokens"))


@query("seq_flatten")
def q_seq_flatten(spark, sf_dir):
    _, lengths = SQ.seq_flatten(_doc_tokens(spark, sf_dir), "job_id", "tokens")
    return lengths


@query("seq_unflatten")
def q_seq_unflatten(spark, sf_dir):
    flat, _ = SQ.seq_flatten(_doc_tokens(spark, sf_dir), "job_id", "tokens")
    nested = SQ.seq_unflatten(flat, "job_id", "pos", "item")
    return nested.select("job_id", *_fingerprint(F.col("items")))


@query("prev_next_links")
def q_prev_next_links(spark, sf_dir):
    return SQ.prev_next_links(V.events_v(_t(spark, sf_dir)))


@query("title_sequences")
def q_title_sequences(spark, sf_dir):
    return SQ.title_sequences(V.titles_v(_t(spark, sf_dir)), skew_safe=True)


@query("desc_sequences")
def q_desc_sequences(spark, sf_dir):
    s = SQ.desc_sequences(V.docs_v(_t(spark, sf_dir)), skew_safe=True)
    return s.select("person_id", "seq_pos", *_fingerprint(F.col("tokens")), "seq_len")


@query("length_histogram")
def q_length_histogram(spark, sf_dir):
    lengths = V.events_v(_t(spark, sf_dir)).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    return SQ.length_histogram(lengths, cap=60)


@query("mass_cutoff")
def q_mass_cutoff(spark, sf_dir):
    tw = SQ.normalise(V.topic_words_v(_t(spark, sf_dir)), "topic", "n")
    out = SQ.mass_cutoff(tw, "topic", "word", "n", threshold=0.5)
    return out.select("topic", "word", "n", F.round("weight", 6).alias("weight"), "rank")


@query("topk_per_group")
def q_topk_per_group(spark, sf_dir):
    tw = V.topic_words_v(_t(spark, sf_dir))
    return SQ.topk_per_group(tw, "topic", [F.col("n").desc(), F.col("word").asc()], 10) \
             .select("topic", "word", "n", "rank")


# ---------------------------------------------------------------- E: statistics


def _comp_tit(spark, sf_dir):
    j = V.jobs_v(_t(spark, sf_dir))
    return j.select(TX.clean_name(F.col("company")).alias("company"),
                    TX.clean_name(F.col("title")).alias("title"))


@query("top_company")
def q_top_company(spark, sf_dir):
    return ST.top_labels(_comp_tit(spark, sf_dir), ["company"], 50)


@query("top_title")
def q_top_title(spark, sf_dir):
    return ST.top_labels(_comp_tit(spark, sf_dir), ["title"], 50)


@query("top_company_title")
def q_top_company_title(spark, sf_dir):
    return ST.top_labels(_comp_tit(spark, sf_dir), ["company", "title"], 50)


@query("attr_histograms")
def q_attr_histograms(spark, sf_dir):
    return ST.attr_histograms(V.cust_v(_t(spark, sf_dir)), "resume_id",
                              ["currency", "salary", "state_id"], topn=10)


@query("jobs_per_resume")
def q_jobs_per_resume(spark, sf_dir):
    return ST.jobs_per_resume(V.jobs_v(_t(spark, sf_dir)), max_jobs=21)


@query("count_stats")
def q_count_stats(spark, sf_dir):
    per = ST.jobs_per_resume(V.jobs_v(_t(spark, sf_dir)), max_jobs=21)
    return ST.count_stats(per, "n_jobs", threshold=1)


@query("salary_stats")
def q_salary_stats(spark, sf_dir):
    return ST.salary_stats(V.cust_v(_t(spark, sf_dir)), currency="BUILDING")


@query("currency_counts")
def q_currency_counts(spark, sf_dir):
    return ST.currency_counts(V.cust_v(_t(spark, sf_dir)))


@query("value_histogram")
def q_value_histogram(spark, sf_dir):
    return ST.value_histogram(V.cust_v(_t(spark, sf_dir)), "salary", width=100, upper=10000)


@query("value_sample")
def q_value_sample(spark, sf_dir):
    c = V.cust_v(_t(spark, sf_dir))
    return ST.value_sample(c, "resume_id", 100, seed=7).select("resume_id", "salary")


@query("title_histogram")
def q_title_histogram(spark, sf_dir):
    return ST.label_histogram(V.titles_v(_t(spark, sf_dir)), "title")


@query("locations_by_size")
def q_locations_by_size(spark, sf_dir):
    return ST.locations_by_size(V.locs_v(_t(spark, sf_dir)), pattern="% %", limit=5)


def _country_locs(spark, sf_dir):
    """Locations with the customer's nation as country, blank for every fourth."""
    t = _t(spark, sf_dir)
    nation = t.nation.select(F.col("n_nationkey").alias("_n"), "n_name")
    locs = t.customer.join(nation, F.col("c_nationkey") == F.col("_n")).select(
        F.concat(F.lower("c_mktsegment"), F.lit(" "), F.lower("n_name")).alias("location"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("n_name")).alias("country"))
    return locs


@query("locations_blank_country")
def q_locations_blank_country(spark, sf_dir):
    return ST.locations_by_size(_country_locs(spark, sf_dir), extra_filter=F.col("country").isNull())


@query("locations_other_country")
def q_locations_other_country(spark, sf_dir):
    return ST.locations_by_size(_country_locs(spark, sf_dir), extra_filter=F.col("country") != "UNITED STATES")


@query("max_id_where")
def q_max_id_where(spark, sf_dir):
    return ST.max_id_where(V.locs_v(_t(spark, sf_dir)), "job_id",
                           F.col("location").like("%new york%"))


def _trace_means(spark, sf_dir, burn=0, lag=1):
    return ST.trace_mean(V.trace_v(_t(spark, sf_dir)), ["s1", "s2"], burn=burn, lag=lag)


@query("trace_mean")
def q_trace_mean(spark, sf_dir):
    m = _trace_means(spark, sf_dir, burn=4, lag=2)
    return m.select("s1", "s2", F.round("mean", 6).alias("mean"))


@query("trace_mode_state")
def q_trace_mode_state(spark, sf_dir):
    e = V.events_v(_t(spark, sf_dir))
    return ST.trace_mode_state(e, "person_id", "title")


@query("top_transitions")
def q_top_transitions(spark, sf_dir):
    return ST.top_transitions(_trace_means(spark, sf_dir))


@query("state_mobility")
def q_state_mobility(spark, sf_dir):
    return ST.state_mobility(_trace_means(spark, sf_dir))


def _title_vocab(spark, sf_dir):
    t = _kept(V.titles_v(_t(spark, sf_dir)), "titles")
    seqs = _kept(SQ.title_sequences(t, skew_safe=True, written=True), "title_sequences")
    return ST.vocab_encode(_counted_titles(t), seqs)


def _counted_titles(t):
    """Cleaned titles of the people with several jobs (counted by an aggregate, not in a window)."""
    several = t.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("person_id")
    return t.where(F.col("title").isNotNull() & (F.col("title") != "")).join(several, "person_id", "left_semi") \
            .select(TX.clean_title(F.col("title")).alias("title"))


@query("vocab_encode")
def q_vocab_encode(spark, sf_dir):
    vocab, _ = _title_vocab(spark, sf_dir)
    return vocab


@query("vocab_encoded_sequences")
def q_vocab_encoded_sequences(spark, sf_dir):
    _, enc = _title_vocab(spark, sf_dir)
    return enc.select("person_id", "seq_pos", "id")


@query("merge_counts")
def q_merge_counts(spark, sf_dir):
    d = V.docs_v(_t(spark, sf_dir))
    toks = d.select("lang", F.explode(TX.tokens_nostop(F.col("description"))).alias("title"))
    # a shard for each language, null included, from one pass over the texts
    return ST.merge_counts(toks.groupBy("lang", "title").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- D: joins


def _kept_jobs(spark, sf_dir, *columns: str):
    """The jobs with these text columns, written for several readers."""
    return _kept(_staged_jobs(_t(spark, sf_dir), *columns), "jobs")


def _staged_jobs(t, *columns: str):
    return V.jobs_v(t, columns, keep=lambda j: _kept(j, "joined_jobs"))


def _filled_jobs(spark, sf_dir, blank_loc_every: int | None = None, jobs=None):
    """``jobs``: the jobs as written for several readers."""
    j = V.jobs_v(_t(spark, sf_dir)) if jobs is None else jobs
    if blank_loc_every:
        # the other copy lost the locations of some people's jobs
        j = j.withColumn("location", F.when(F.col("person_id") % blank_loc_every == 0, F.lit(""))
                         .otherwise(F.col("location")))
    return SQ.stint_fill(j, skew_safe=True, written=jobs is not None)


def _fingerprint_match(spark, sf_dir):
    jobs = _kept_jobs(spark, sf_dir, "company", "location")
    # both are read for their fingerprints and for their jobs
    table = _kept(_filled_jobs(spark, sf_dir, jobs=jobs), "filled_table")
    probe = _kept(_filled_jobs(spark, sf_dir, blank_loc_every=7, jobs=jobs).drop("job_id"), "filled_probe")
    key = TX.company_key(F.col("company"), F.col("location"))
    probe = probe.withColumn("_key", key)
    pc, pl = TX.split_company_key(F.col("_key"))
    t_fields = [F.col("start_dt"), F.col("end_dt"), TX.clean_name(F.col("company")),
                TX.clean_name(F.col("location"))]
    p_fields = [F.col("start_dt"), F.col("end_dt"), pc, pl]
    return JN.match_by_fingerprint(table, probe, "person_id", "seq_pos", t_fields, p_fields)


@query("match_by_fingerprint")
def q_match_by_fingerprint(spark, sf_dir):
    jobs, _ = _fingerprint_match(spark, sf_dir)
    return jobs


@query("match_counts")
def q_match_counts(spark, sf_dir):
    _, counts = _fingerprint_match(spark, sf_dir)
    return counts


@query("align_positional")
def q_align_positional(spark, sf_dir):
    j = _kept_jobs(spark, sf_dir)
    left = _filled_jobs(spark, sf_dir, jobs=j)
    # the other copy lost some dates: stints with none are dropped (length
    # changes), others are re-filled differently (job mismatch)
    j = (j.withColumn("start_dt", F.when(F.col("pos") % 13 == 0, None).otherwise(F.col("start_dt")))
          .withColumn("end_dt", F.when(F.col("pos") % 13 == 0, None)
                      .when(F.col("pos") % 5 == 0, None).otherwise(F.col("end_dt"))))
    right = SQ.stint_fill(j, skew_safe=True, written=True)
    return JN.align_positional(left, right, "person_id", "seq_pos", "start_dt", "end_dt")


def _coworker_stints(spark, sf_dir):
    j = V.jobs_v(_t(spark, sf_dir))
    return j.select("person_id", "pos", "company", F.year("start_dt").alias("start_year"),
                    F.year("end_dt").alias("end_year"))


@query("coworker_links")
def q_coworker_links(spark, sf_dir):
    return JN.coworker_link_counts(_coworker_stints(spark, sf_dir))


@query("coworker_degree")
def q_coworker_degree(spark, sf_dir):
    return JN.coworker_degree(JN.coworker_person_counts(_coworker_stints(spark, sf_dir)), 50)


def _filled_stints(spark, sf_dir):
    jobs = V.jobs_v(_t(spark, sf_dir)).select("person_id", "pos", "company", "start_dt", "end_dt")
    return SQ.stint_fill(jobs, skew_safe=True)


@query("shared_employers")
def q_shared_employers(spark, sf_dir):
    """Every pair of people and the companies that they were at together,
    summed up by person."""
    filled = _kept(_filled_stints(spark, sf_dir), "filled")  # both sides of the pairs read it
    return JN.shared_employer_links(JN.shared_employers(filled))


@query("shared_employer_counts")
def q_shared_employer_counts(spark, sf_dir):
    """D5 by company, without pairs of people."""
    return JN.shared_employer_counts(_filled_stints(spark, sf_dir))


@query("shared_employer_pairs")
def q_shared_employer_pairs(spark, sf_dir):
    """D5 as pairs, for one person (all pairs grow with the square of a
    company; see shared_employers for each person's numbers)."""
    jobs = _kept(V.jobs_v(_t(spark, sf_dir)).select("person_id", "pos", "company", "start_dt", "end_dt"), "jobs")
    # the first of the people with a filled stint: those are the ones with a date
    first = jobs.where(F.col("start_dt").isNotNull() | F.col("end_dt").isNotNull()).agg(F.min("person_id").alias("person_id"))
    return JN.shared_employers(_filled_jobs(spark, sf_dir, jobs=jobs), people=first)


@query("gazetteer_geocode")
def q_gazetteer_geocode(spark, sf_dir):
    locs = V.locs_v(_t(spark, sf_dir))
    return JN.gazetteer_geocode(locs, gazetteer(spark), fallbacks=[LOC.unconcat_state])


@query("compound_place_fix")
def q_compound_place_fix(spark, sf_dir):
    locs = V.locs_v(_t(spark, sf_dir))
    return JN.compound_place_fix(locs, JN.compound_dictionary(locs, limit=20000))


@query("job_transition_probs")
def q_job_transition_probs(spark, sf_dir):
    t = _t(spark, sf_dir)
    means = ST.trace_mean(V.trace_v(t), ["s1", "s2"]).select(
        F.col("s1").alias("title"), F.col("s2").alias("next_title"), F.col("mean").alias("n"))
    ev = V.events_v(t).withColumnRenamed("title", "state")
    k = ev.agg(F.count_distinct("state")).scalar()
    probs = TR.transition_probs(means, num_states=k)
    out = JN.job_transition_probs(ev, probs)
    return out.select("job_id1", "job_id2", "state1", "state2", "trans_prob")


def _state_topics(t):
    tv = V.topics_v(t)
    return (tv.select("state", F.posexplode("embedding").alias("topic", "x"))
              .groupBy("state", F.col("topic").cast("bigint").alias("topic"))
              .agg(F.sum("x").alias("mass")))


def _topic_word_weights(t):
    tw = SQ.normalise(V.topic_words_v(t), "topic", "n")
    return tw.select("topic", "word", "weight")


@query("state_word_mix")
def q_state_word_mix(spark, sf_dir):
    t = _t(spark, sf_dir)
    return JN.state_word_mix(_state_topics(t), _topic_word_weights(t), n_words=10)


def _title_seqs(spark, sf_dir):
    return SQ.title_sequences(V.titles_v(_t(spark, sf_dir)), skew_safe=True)


@query("split_sequences")
def q_split_sequences(spark, sf_dir):
    """The first 50 people train."""
    s = SP.split_sequences(_title_seqs(spark, sf_dir), "person_id", 50)
    return s.select("person_id", "seq_pos", "split")


@query("unseen_anti")
def q_unseen_anti(spark, sf_dir):
    # few train, so that titles are left unseen
    s = SP.split_by_hash(_title_seqs(spark, sf_dir), "person_id", 2)
    train = s.where(F.col("split") == "train")
    vocab, _ = ST.vocab_encode(train.select("title"), train)
    held = s.where(F.col("split") == "test")
    unseen = JN.unseen_anti(held, vocab)
    return held.join(unseen, "title", "left_semi").groupBy("title").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- A: sources and sinks

_XML_SHARDS: dict[tuple[str, str], list[str]] = {}


def xml_shards(spark, sf_dir) -> list[str]:
    """The xml_v fixture: résumé XML shards derived from the driver tables by
    a Spark job, written once per session under the checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _XML_SHARDS:
        t = _t(spark, sf_dir)
        frame = RX.resume_frame(_staged_jobs(t, "company", "title", "location"), t.customer, t.nation)
        _XML_SHARDS[key] = RX.write_shards(frame, stage_path(spark, "xml_v"))
    return _XML_SHARDS[key]


def _raw_resumes(spark, sf_dir):
    return RX.read_resumes(spark, xml_shards(spark, sf_dir))


def _n(c) -> F.Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


@query("src_xml_resumes")
def q_src_xml_resumes(spark, sf_dir):
    r = _raw_resumes(spark, sf_dir)
    return r.select(F.col("ResumeID").try_cast("int").alias("resume_id"),
                    _n(F.col("experience.experiencerecord")).alias("n_experience"),
                    _n(F.col("education.schoolrecord")).alias("n_education"),
                    _n(F.col("locations.location")).alias("n_locations"))


@query("attr_histograms_xml")
def q_attr_histograms_xml(spark, sf_dir):
    return ST.element_histograms(XT.attr_rows(XT.tag_counts(spark, xml_shards(spark, sf_dir))), topn=10)


def _broken_shard(spark, sf_dir) -> str:
    return RX.write_broken_shard(_t(spark, sf_dir).customer, stage_path(spark, "xml_broken"))


@query("xml_bad_records")
def q_xml_bad_records(spark, sf_dir):
    """Records that the reader can't parse; those around them stay."""
    raw = RX.read_resumes(spark, _broken_shard(spark, sf_dir))
    sound = RX.sound_records(raw).select("ResumeID", F.lit(None).cast("string").alias("record"))
    return RX.corrupt_records(raw).unionByName(sound).withColumnRenamed("ResumeID", "resume_id")


@query("etl_resumes")
def q_etl_resumes(spark, sf_dir):
    return RX.etl_resumes(_raw_resumes(spark, sf_dir))


@query("etl_jobs")
def q_etl_jobs(spark, sf_dir):
    return RX.etl_jobs(_raw_resumes(spark, sf_dir))


@query("etl_schools")
def q_etl_schools(spark, sf_dir):
    return RX.etl_schools(_raw_resumes(spark, sf_dir))


@query("xml_schema_paths")
def q_xml_schema_paths(spark, sf_dir):
    return XT.schema_paths(XT.tag_counts(spark, xml_shards(spark, sf_dir), values=False))


@query("parse_flags")
def q_parse_flags(spark, sf_dir):
    r = _raw_resumes(spark, sf_dir)
    return r.select(F.col("ResumeID").try_cast("int").alias("resume_id"),
                    *[RX.parse_flag(F.col(t)).alias(RX.COLUMN_OF[t]) for t in RX.FLAG_TAGS])


@query("snake_columns")
def q_snake_columns(spark, sf_dir):
    r = _raw_resumes(spark, sf_dir)
    return RX.column_fill(r)


@query("state_list")
def q_state_list(spark, sf_dir):
    r = _raw_resumes(spark, sf_dir)
    return r.select(F.col("ResumeID").try_cast("int").alias("resume_id"),
                    RX.state_list(F.col("locations.location")).alias("state"))


@query("split_files")
def q_split_files(spark, sf_dir):
    shards = SP.split_files(xml_shards(spark, sf_dir), skip=1, n=1)
    r = RX.read_resumes(spark, shards)
    return r.select(F.col("ResumeID").try_cast("int").alias("resume_id"))


@query("seq_jsonl_roundtrip")
def q_seq_jsonl_roundtrip(spark, sf_dir):
    filled = SQ.stint_fill(_staged_jobs(_t(spark, sf_dir), "company", "title").drop("job_id"), skew_safe=True)
    # a topic vector for each stint, written and read with it
    filled = filled.withColumn("topics", F.array((F.col("seq_pos") / 4).cast("double"),
                                                 F.length("title").cast("double")))
    path = stage_path(spark, "stints_jsonl")
    SIO.write_sequences_jsonl(filled, path, desc="title", vector="topics")
    back = SIO.read_sequences_jsonl(spark, path)
    return back.select("person_id", "seq_pos", "start_dt", "end_dt", "company", "description",
                       F.col("topics")[0].alias("t0"), F.col("topics")[1].alias("t1"))


def _event_lengths(spark, sf_dir):
    return V.events_v(_t(spark, sf_dir)).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))


@query("seq_load_limit")
def q_seq_load_limit(spark, sf_dir):
    return SIO.load_limit(_event_lengths(spark, sf_dir), "person_id", min_len=3, max_entries=3000) \
              .select("person_id", F.col("n").cast("bigint").alias("n"), "before")


@query("seq_scan_stats")
def q_seq_scan_stats(spark, sf_dir):
    tv = V.topics_v(_t(spark, sf_dir))
    lengths = tv.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"),
                                          F.max(F.size("embedding")).alias("width"))
    kept = SIO.load_limit(lengths, "person_id", min_len=3, max_entries=1000)
    return SIO.scan_stats(kept, "person_id", "n", F.col("width"))


def _trace_store(spark, sf_dir):
    tr = V.trace_v(_t(spark, sf_dir))
    store = SIO.TraceStore(stage_path(spark, "trace"))
    starts = tr.groupBy("iter", "s1").agg(F.sum("n").alias("n"))
    store.append({"trans": tr, "starts": starts}, erase=True)
    return store


@query("trace_latest")
def q_trace_latest(spark, sf_dir):
    store = _trace_store(spark, sf_dir)
    latest = store.latest(spark, ["trans", "starts"])
    return latest["trans"].select(F.col("iter").cast("bigint").alias("iter"), "s1", "s2", "n")


@query("trace_append")
def q_trace_append(spark, sf_dir):
    store = _trace_store(spark, sf_dir)
    # a second run appends iterations 20..39 after the first twenty
    more = V.trace_v(_t(spark, sf_dir)).withColumn("iter", F.col("iter") + 20)
    store.append({"trans": more})
    return store.read(spark, "trans").groupBy(F.col("iter").cast("bigint").alias("iter")) \
                .agg(F.sum("n").cast("bigint").alias("n"))


@query("topic_vectors_wide")
def q_topic_vectors_wide(spark, sf_dir):
    tv = V.topics_v(_t(spark, sf_dir)).withColumn(
        "embedding", F.transform("embedding", lambda x: F.round(x, 6)))
    return SIO.wide_vectors(tv, "job_id", "embedding", 64)


@query("add_column")
def q_add_column(spark, sf_dir):
    locs = V.locs_v(_t(spark, sf_dir))
    return SIO.add_column(SIO.add_column(locs, "city", "string"), "latitude", "double")


@query("upsert_attrs")
def q_upsert_attrs(spark, sf_dir):
    locs = V.locs_v(_t(spark, sf_dir))
    target = SIO.add_column(SIO.add_column(SIO.add_column(locs, "city", "string"), "state", "string"),
                            "country", "string")
    geo = JN.gazetteer_geocode(locs.select("location").distinct(), gazetteer(spark),
                               fallbacks=[LOC.unconcat_state])
    updates = geo.where(F.col("matched_by").isNotNull()).select("location", "city", "state", "country")
    return JN.upsert_attrs(target, updates, ["location"], ["city", "state", "country"])


# ---------------------------------------------------------------- text and topic models


def _docs(spark, sf_dir):
    return V.docs_v(_t(spark, sf_dir))


@query("doc_term_matrix")
def q_doc_term_matrix(spark, sf_dir):
    return TXT.vocabulary(_docs(spark, sf_dir), "job_id", "description")


@query("bigram_llr")
def q_bigram_llr(spark, sf_dir):
    b = TXT.bigram_llr(_docs(spark, sf_dir), "job_id", "description", num=1000)
    return b.select("w1", "w2", "n", F.round("score", 6).alias("score"))


@query("bigram_replace")
def q_bigram_replace(spark, sf_dir):
    d = _docs(spark, sf_dir)
    bigrams = TXT.bigram_llr(d, "job_id", "description", num=1000)
    toks = d.select("job_id", TX.tokens_wordpunct(F.col("description")).alias("tokens"))
    out = TXT.bigram_replace(toks, "job_id", "tokens", bigrams)
    return out.select("job_id", *_fingerprint(F.col("tokens")))


@query("clean_descriptions")
def q_clean_descriptions(spark, sf_dir):
    return TXT.clean_descriptions(_docs(spark, sf_dir), "job_id", "description", num=1000)


def _lda(spark, sf_dir, docs=None, k=8, max_iter=6, counts=None):
    d = _docs(spark, sf_dir) if docs is None else docs
    return TOP.fit_lda(d, "job_id", "description", k=k, max_iter=max_iter, seed=11, counts=counts)


@query("lda_topics")
def q_lda_topics(spark, sf_dir):
    d = _docs(spark, sf_dir)
    counts = TOP.term_counts(d, "job_id", "description")
    model = _lda(spark, sf_dir, counts=counts)
    return TOP.lda_doc_topics(model, d, "job_id", "description", normalized=False, counts=counts)


@query("lda_topic_words")
def q_lda_topic_words(spark, sf_dir):
    return TOP.lda_topic_words(_lda(spark, sf_dir), threshold=0.5)


@query("lda_topic_mass")
def q_lda_topic_mass(spark, sf_dir):
    """Weight of every word over all topics: its tokens plus the prior, as
    each pass reads every document."""
    model = _lda(spark, sf_dir, max_iter=3)
    return model.weights.select("word", F.round(sum(F.col(c) for c in model.columns), 4).alias("mass"))


@query("lda_transform_heldout")
def q_lda_transform_heldout(spark, sf_dir):
    d = _docs(spark, sf_dir).select("job_id", "description")
    s = SP.split_by_hash(d, "job_id", TRAIN_PCT)
    model = _lda(spark, sf_dir, docs=s.where("split = 'train'"))
    path = stage_path(spark, "lda_model")
    TOP.save_model(model, path)
    return TOP.lda_transform_heldout(spark, path, s.where("split = 'test'"), "job_id", "description")


def _norm_topics(spark, sf_dir):
    return TOP.normalise_vectors(V.topics_v(_t(spark, sf_dir)), "embedding")


@query("doc_top_topics")
def q_doc_top_topics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return TOP.doc_top_topics(_norm_topics(spark, sf_dir), "job_id", "embedding", _topic_word_weights(t))


@query("dominant_topic")
def q_dominant_topic(spark, sf_dir):
    return TOP.dominant_topic(V.topics_v(_t(spark, sf_dir)), "job_id", "embedding")


@query("state_topic_mix")
def q_state_topic_mix(spark, sf_dir):
    t = _t(spark, sf_dir)
    return TOP.state_topic_mix(_state_topics(t), _topic_word_weights(t))


# ---------------------------------------------------------------- iterative models


def _hmm_data(spark, sf_dir):
    """Title sequences split into train / held-out by person, encoded with the
    training vocabulary (titles unseen in training encode as 0)."""
    # the split sequences feed the vocabulary, both encodings and the fit:
    # materialise them once in the checkpoint folder
    t = _kept(V.titles_v(_t(spark, sf_dir)), "titles")
    seqs = SQ.title_sequences(t, skew_safe=True, written=True)
    s = _kept(SP.split_by_hash(seqs, "person_id", TRAIN_PCT), "title_sequences")
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    tr_people = train.select("person_id").distinct()
    vocab, enc_train = ST.vocab_encode(_counted_titles(t.join(tr_people, "person_id", "left_semi")), train)
    enc_test = test.join(vocab.select("title", "id"), "title", "left") \
                   .withColumn("id", F.coalesce("id", F.lit(0).cast("bigint")))
    return vocab, enc_train, enc_test


def _hmm_model(spark, sf_dir, n_states=8, n_iter=8):
    vocab, enc_train, enc_test = _hmm_data(spark, sf_dir)
    model = HM.fit_em(enc_train, n_states, n_iter=n_iter, seed=3)
    return model, vocab, enc_test


@query("hmm_fit_em")
def q_hmm_fit_em(spark, sf_dir):
    model, _, _ = _hmm_model(spark, sf_dir)
    return model.to_frame(spark)


@query("hmm_score")
def q_hmm_score(spark, sf_dir):
    model, _, enc_test = _hmm_model(spark, sf_dir)
    return HM.score(model, enc_test)


@query("hmm_decode_next")
def q_hmm_decode_next(spark, sf_dir):
    model, vocab, enc_test = _hmm_model(spark, sf_dir)
    nxt = HM.decode_next(model, enc_test)
    labels = vocab.where("id > 0").select(F.col("id").alias("next_id"), F.col("title").alias("next_title"))
    return nxt.join(labels, "next_id", "left")


def _numbered(df, label: str):
    """The rows with an id from 0 for each distinct label, in label order."""
    ids = SQ.range_row_number(df.select(label).distinct().withColumn("_all", F.lit(0)), "_all", [label], "id")
    return df.join(ids.select(label, (F.col("id") - 1).alias("id")), label)


def _given_model(spark, encoded, n_states=3) -> HM.HmmModel:
    """A model by formula over the symbols of ``encoded``, so that SQL has it too."""
    weight = lambda i, j: 1 + ((7 * i + 3 * j + 1) ** 2 * 0.1234567) % 1 + 2 * (i == j)
    A = np.array([[weight(i, j) for j in range(n_states)] for i in range(n_states)])
    pi = np.array([1.0 + i for i in range(n_states)])
    cs = [(1 + ((F.lit(5 * i + 2) + 3 * F.col("sym")) * (F.lit(5 * i + 2) + 3 * F.col("sym")) * 0.7654321) % 1).alias(f"c{i}")
          for i in range(n_states)]
    symbols = encoded.select(F.col("id").alias("sym")).distinct().select("sym", *cs)
    return HM.HmmModel(pi / pi.sum(), A / A.sum(axis=1, keepdims=True), HM._emission_table(symbols, n_states))


def _given_events(spark, sf_dir):
    enc = _numbered(V.events_v(_t(spark, sf_dir)).select("person_id", "pos", "title"), "title")
    return enc, _given_model(spark, enc)


@query("hmm_em_step")
def q_hmm_em_step(spark, sf_dir):
    """F8: one step of the fit, from a given model over the event histories."""
    enc, model = _given_events(spark, sf_dir)
    new = HM.fit_em(enc, model.n_states, n_iter=1, pos="pos", model=model)
    return new.to_frame(spark).withColumn("value", F.round("value", 6))


@query("hmm_score_events")
def q_hmm_score_events(spark, sf_dir):
    """F9 with a given model."""
    enc, model = _given_events(spark, sf_dir)
    return HM.score(model, enc, pos="pos").withColumn("loglik", F.round("loglik", 6))


@query("hmm_path_events")
def q_hmm_path_events(spark, sf_dir):
    """the most likely states with a given model."""
    enc, model = _given_events(spark, sf_dir)
    return HM.decode_paths(model, enc, pos="pos").select("person_id", "pos", "state")


@query("hmm_decode_events")
def q_hmm_decode_events(spark, sf_dir):
    """last and next state and the next event with a given model."""
    enc, model = _given_events(spark, sf_dir)
    titles = enc.select(F.col("id").alias("next_id"), F.col("title").alias("next_title")).distinct()
    return HM.decode_next(model, enc, pos="pos").join(titles, "next_id").drop("next_id")


def _topic_histories(spark, sf_dir):
    """Each job's dominant topic as its symbol (labels 0..n-1)."""
    tv = V.topics_v(_t(spark, sf_dir))
    top = TOP.dominant_topic(tv, "job_id", "embedding").withColumnRenamed("label", "id")
    return tv.select("job_id", "person_id", (F.col("pos") + 1).alias("pos")).join(top, "job_id")


@query("hmm_topics_next")
def q_hmm_topics_next(spark, sf_dir):
    """F8-F10 on dominant topics: fitted on the training people, the topic that
    each held-out history is expected to go on with."""
    s = SP.split_by_hash(_topic_histories(spark, sf_dir), "person_id", TRAIN_PCT).checkpoint()
    model = HM.fit_em(s.where("split = 'train'"), 6, n_iter=6, seed=3, pos="pos")
    nxt = HM.decode_next(model, s.where("split = 'test'"), pos="pos")
    topics = s.select(F.col("id").alias("next_id"), F.col("topic").alias("next_topic")).distinct()
    return nxt.join(topics, "next_id").drop("next_id")


@query("hmm_topics_path")
def q_hmm_topics_path(spark, sf_dir):
    """F10 on dominant topics with a given model."""
    enc = _topic_histories(spark, sf_dir)
    return HM.decode_paths(_given_model(spark, enc), enc, pos="pos").select("person_id", "pos", "state")


def _gibbs_docs(spark, sf_dir):
    tv = V.topics_v(_t(spark, sf_dir))
    return tv.select("job_id", "person_id", "pos", "state", F.col("embedding").alias("x"))


def _gibbs_setup(spark, sf_dir):
    docs = _gibbs_docs(spark, sf_dir)
    n_states, n_topics, n_seqs = docs.agg(F.max("state") + 1, F.max(F.size("x")), F.count_distinct("person_id")).first()
    return docs, GB.Priors(int(n_states), int(n_topics)), int(n_seqs)


@query("gibbs_state_tables")
def q_gibbs_state_tables(spark, sf_dir):
    t = GB.state_tables(_gibbs_docs(spark, sf_dir))
    return t.select("kind", "i", "j", F.round("value", 6).alias("value"))


@query("state_topic_loglik")
def q_state_topic_loglik(spark, sf_dir):
    docs, priors, n_seqs = _gibbs_setup(spark, sf_dir)
    return GB.loo_scores(docs, GB.state_tables(docs), n_seqs, priors, part="topic")


@query("state_seq_loglik")
def q_state_seq_loglik(spark, sf_dir):
    docs, priors, n_seqs = _gibbs_setup(spark, sf_dir)
    return GB.loo_scores(docs, GB.state_tables(docs), n_seqs, priors, part="trans")


@query("gibbs_init_totals")
def q_gibbs_init_totals(spark, sf_dir):
    """Counts of the first pass summed over the states: whatever the draws,
    each history has one start, each pair of neighbours one transition, and
    each topic the mass of all jobs."""
    docs, priors, _ = _gibbs_setup(spark, sf_dir)
    states, _ = GB.init_states(docs, priors, seed=5)
    t = GB.state_tables(states, state="z")
    j = F.when(F.col("kind") == "topic", F.col("j")).otherwise(F.lit(0))
    return t.groupBy("kind", j.alias("j")).agg(F.round(F.sum("value"), 6).alias("value"))


@query("gibbs_hmm_fit")
def q_gibbs_hmm_fit(spark, sf_dir):
    docs, priors, _ = _gibbs_setup(spark, sf_dir)
    store = SIO.TraceStore(stage_path(spark, "gibbs_trace"))
    final, _ = GB.fit_gibbs(docs, priors, n_iter=3, seed=5, store=store, lag=1)
    return final.select("job_id", "person_id", "pos", F.col("z").alias("state"))


@query("gibbs_resume")
def q_gibbs_resume(spark, sf_dir):
    docs, priors, _ = _gibbs_setup(spark, sf_dir)
    store = SIO.TraceStore(stage_path(spark, "gibbs_trace"))
    GB.fit_gibbs(docs, priors, n_iter=2, seed=5, store=store, lag=1)
    final, _ = GB.resume_gibbs(spark, store, docs, priors, n_iter=1, seed=5)
    return final.select("job_id", "person_id", "pos", F.col("z").alias("state"))


# ---------------------------------------------------------------- separate keys for single functions
@query("clean_title_loose")
def q_clean_title_loose(spark, sf_dir):
    t = V.titles_v(_t(spark, sf_dir))
    return t.select("person_id", "pos", TX.clean_title_loose(F.col("title")).alias("clean"))


@query("unconcat_state")
def q_unconcat_state(spark, sf_dir):
    l = V.locs_v(_t(spark, sf_dir))
    return l.select("job_id", LOC.unconcat_state(F.col("location")).alias("unconcat"))


@query("strip_country")
def q_strip_country(spark, sf_dir):
    l = V.locs_v(_t(spark, sf_dir))
    return l.select("job_id", LOC.strip_country(LOC.preprocess_loc(F.col("location"))).alias("stripped"))


@query("title_distinct")
def q_title_distinct(spark, sf_dir):
    t = V.titles_v(_t(spark, sf_dir))
    return t.agg(F.count_distinct("title").alias("n_titles"), F.count(F.lit(1)).alias("n_jobs"))

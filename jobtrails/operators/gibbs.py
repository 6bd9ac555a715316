"""Collapsed Gibbs sampling of job states over topic vectors.

Every job (document) of a history carries a topic vector ``x`` and a hidden
state ``z``; states emit topic mass through a Dirichlet-multinomial and
follow each other through a Dirichlet-smoothed transition table.

The first states come from one pass in order: histories are numbered, and
blocks that double in size are drawn one after another, each from the counts
of all blocks before it.  Inside a block, chunks of ``CHUNK`` histories run in
parallel; a chunk draws its histories one by one and sees its own draws.

After that the sequential sampler is distributed the way approximate
distributed LDA is (Newman, Asuncion, Smyth & Welling, JMLR 2009): each sweep

1. aggregates the global count tables from the current assignment (F14,
   plain ``groupBy`` sums -- S, S*S, S*T numbers),
2. broadcasts them frozen,
3. lets every history, inside its task, remove its own contribution, resample
   its jobs in order (F11 + F12) with a generator seeded by (seed, sweep,
   history) and put its contribution back, and
4. emits the new states; the state table is checkpointed every few sweeps.

Each history sees the frozen counts plus its own updates only, sums are exact
decimals and generators are seeded by the data, so a result does not depend on
how histories are spread over tasks.  What crosses the driver per sweep is the
count tables (model-sized), never the documents.  The scores as queries (F11,
F12) are Column expressions over joins with those tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrails.functions import special as SP
from jobtrails.operators.seqbatch import by_sequence, lgamma, seeded_rng, whole_sequences
from jobtrails.operators.sequences import range_row_number
from jobtrails.session import stage_path

BASE = 256    # histories of the first block of the initial pass; the next has twice as many
CHUNK = 64    # histories of a block that are drawn one after another; divides BASE


@dataclass
class Priors:
    n_states: int
    n_topics: int
    pi: float = 1000.0     # start-state prior
    gamma: float = 1.0     # transition prior

    @property
    def alpha(self) -> float:  # symmetric topic prior; sum over topics = n_topics
        return 1.0

    @property
    def sum_alpha(self) -> float:
        return float(self.n_topics)


@dataclass
class Counts:
    start: np.ndarray       # (S,)
    trans: np.ndarray       # (S, S)
    tots: np.ndarray        # (S,)  outgoing transitions per state
    topics: np.ndarray      # (S, T) topic mass per state
    totals: np.ndarray      # (S,)  document length per state
    n_seqs: int

    @classmethod
    def zeros(cls, p: Priors, n_seqs: int) -> Counts:
        s, t = p.n_states, p.n_topics
        return cls(np.zeros(s), np.zeros((s, s)), np.zeros(s), np.zeros((s, t)), np.zeros(s), n_seqs)

    def copy(self) -> Counts:
        return Counts(*(v.copy() if isinstance(v := getattr(self, f.name), np.ndarray) else v for f in fields(self)))

    def add(self, other: Counts) -> None:
        for name in ("start", "trans", "tots", "topics", "totals"):
            getattr(self, name)[...] += getattr(other, name)


# ---------------------------------------------------------------- F14
def state_tables(docs: DataFrame, seq: str = "person_id", pos: str = "pos", state: str = "state",
                 vec: str = "x") -> DataFrame:
    """sufficient statistics of an assignment as one long table
    (kind, i, j, value): start counts, transition counts, state-topic mass
    and state totals (document length = sum of its topic vector)."""
    w = Window.partitionBy(seq).orderBy(pos)
    d = docs.select(seq, pos, F.col(state).cast("int").alias("z"), vec,
                    F.lag(F.lit(1)).over(w).isNull().alias("_first"),
                    F.lead(F.col(state)).over(w).cast("int").alias("_next"))
    starts = d.where("_first").groupBy(F.col("z").alias("i")) \
              .agg(F.count(F.lit(1)).cast("double").alias("value")) \
              .select(F.lit("start").alias("kind"), "i", F.lit(0).alias("j"), "value")
    trans = d.where(F.col("_next").isNotNull()).groupBy(F.col("z").alias("i"), F.col("_next").alias("j")) \
             .agg(F.count(F.lit(1)).cast("double").alias("value")) \
             .select(F.lit("trans").alias("kind"), "i", "j", "value")
    topics = d.select("z", F.posexplode(vec).alias("t", "x")) \
              .groupBy(F.col("z").alias("i"), F.col("t").alias("j")).agg(SP.exact_sum(F.col("x")).alias("value")) \
              .select(F.lit("topic").alias("kind"), "i", "j", "value")
    totals = d.groupBy(F.col("z").alias("i")) \
              .agg(SP.exact_sum(F.aggregate(vec, F.lit(0.0), lambda a, b: a + b)).alias("value")) \
              .select(F.lit("total").alias("kind"), "i", F.lit(0).alias("j"), "value")
    return starts.unionByName(trans).unionByName(topics).unionByName(totals)


def collect_counts(tables: DataFrame, n_seqs: int, n_states: int, n_topics: int) -> Counts:
    """Model-sized count tables -> numpy (the only thing the driver holds)."""
    c = Counts(np.zeros(n_states), np.zeros((n_states, n_states)), np.zeros(n_states),
               np.zeros((n_states, n_topics)), np.zeros(n_states), n_seqs)
    for r in tables.collect():
        k, i, j, v = r["kind"], r["i"], r["j"], r["value"]
        if k == "start":
            c.start[i] = v
        elif k == "trans":
            c.trans[i, j] = v
        elif k == "topic":
            c.topics[i, j] = v
        elif k == "total":
            c.totals[i] = v
    c.tots = c.trans.sum(axis=1)
    return c


# ---------------------------------------------------------------- F11 / F12 (numpy)
def topic_loglik(x: np.ndarray, length: float, c: Counts, p: Priors) -> np.ndarray:
    """Dirichlet-multinomial log score of topic vector ``x`` under each
    state: sum_t [lnG(c_st + a + x_t) - lnG(c_st + a)] + lnG(C_s + A) - lnG(C_s + A + len)."""
    den = c.topics + p.alpha
    nz = x > 0
    s = (lgamma(den[:, nz] + x[nz]) - lgamma(den[:, nz])).sum(axis=1)
    num = c.totals + p.sum_alpha
    return s + lgamma(num) - lgamma(num + length)


def transition_loglik(prev: int | None, old: int, nxt: int | None, c: Counts, p: Priors) -> np.ndarray:
    """log weight of each candidate state from its neighbours.

    start: (n_start + pi) / (n_seqs - 1 + S pi), times, when a next job
    exists, (n[s, next] + g) / (n[s, .] + S g) -- divided here as in the
    middle case; end: n[prev, s] + g; middle: (n[prev, s] + g)(n[s, next] +
    g) / (n[s, .] + S g), with the +1 self-transition corrections applied
    when the job's current state equals its previous (and next) state.
    Counts must already exclude the job's own transitions.
    """
    S = p.n_states
    sum_pi, sum_g = p.pi * S, p.gamma * S
    if prev is None:
        lik = (c.start + p.pi) / (c.n_seqs - 1 + sum_pi)
        if nxt is not None:
            lik = lik * (c.trans[:, nxt] + p.gamma) / (c.tots + sum_g)
    elif nxt is None:
        lik = c.trans[prev, :] + p.gamma
    elif prev == old:
        bump = 1.0 if old == nxt else 0.0
        lik = (c.trans[prev, :] + p.gamma) * (c.trans[:, nxt] + bump + p.gamma) / (c.tots + 1 + sum_g)
    else:
        lik = (c.trans[prev, :] + p.gamma) * (c.trans[:, nxt] + p.gamma) / (c.tots + sum_g)
    return np.log(lik)


def _move_trans(c: Counts, z: np.ndarray, d: int, sign: float) -> None:
    """Add (+1) or remove (-1) job d's transition contributions."""
    n = len(z)
    if d == 0:
        c.start[z[d]] += sign
    else:
        c.trans[z[d - 1], z[d]] += sign
    if d < n - 1:
        c.trans[z[d], z[d + 1]] += sign
        c.tots[z[d]] += sign


def _move_topics(c: Counts, z: np.ndarray, X: np.ndarray, L: np.ndarray, d: int, sign: float) -> None:
    c.topics[z[d]] += sign * X[d]
    c.totals[z[d]] += sign * L[d]


def draw(logliks: np.ndarray, rng: np.random.Generator) -> int:
    """Sample an index from unnormalised log weights (max-shifted exp)."""
    w = np.exp(logliks - logliks.max())
    return int(rng.choice(len(w), p=w / w.sum()))


def resample_sequence(z: np.ndarray, X: np.ndarray, L: np.ndarray, c: Counts, p: Priors,
                      rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """One in-order pass over a history; ``c`` holds the frozen global counts
    and has them again, bit for bit, on return: the rows of the states that the
    history touches are kept and put back.  Returns (new states, changes)."""
    z = z.copy()
    names = ("start", "trans", "tots", "topics", "totals")
    kept: dict[int, list] = {}

    def keep(s: int) -> None:
        if s not in kept:
            kept[s] = [np.copy(getattr(c, name)[s]) for name in names]

    for s in set(z.tolist()):
        keep(s)
    changes = 0
    n = len(z)
    for d in range(n):
        _move_trans(c, z, d, -1.0)
        _move_topics(c, z, X, L, d, -1.0)
        prev = int(z[d - 1]) if d > 0 else None
        nxt = int(z[d + 1]) if d < n - 1 else None
        ll = topic_loglik(X[d], L[d], c, p) + transition_loglik(prev, int(z[d]), nxt, c, p)
        s = draw(ll, rng)
        keep(s)
        changes += int(s != z[d])
        z[d] = s
        _move_trans(c, z, d, 1.0)
        _move_topics(c, z, X, L, d, 1.0)
    for s, rows in kept.items():
        for name, row in zip(names, rows, strict=True):
            getattr(c, name)[s] = row
    return z, changes


def draw_sequence(X: np.ndarray, L: np.ndarray, c: Counts, p: Priors, rng: np.random.Generator) -> np.ndarray:
    """First states of a history, job by job: from the starts or the row of the
    state before, times the topic score.  Its draws are added to ``c``."""
    z = np.zeros(len(X), np.int64)
    for d in range(len(X)):
        if d == 0:
            lik = (c.start + p.pi) / (c.n_seqs - 1 + p.pi * p.n_states)
        else:
            lik = c.trans[z[d - 1]] + p.gamma
        z[d] = draw(np.log(lik) + topic_loglik(X[d], L[d], c, p), rng)
        if d == 0:
            c.start[z[d]] += 1
        else:
            c.trans[z[d - 1], z[d]] += 1
            c.tots[z[d - 1]] += 1
        _move_topics(c, z, X, L, d, 1.0)
    return z


# ---------------------------------------------------------------- F11 / F12 as queries
def _neighbours(docs: DataFrame, seq: str, pos: str, state: str) -> DataFrame:
    w = Window.partitionBy(seq).orderBy(pos)
    return docs.withColumn("_prev", F.lag(state).over(w)).withColumn("_next", F.lead(state).over(w))


def topic_score(x: Column, length: Column, counts: Column, total: Column, p: Priors) -> Column:
    """F11 as an expression: arrays of a job's and a state's topic mass."""
    terms = F.zip_with(x, counts, lambda v, c: F.when(v > 0, SP.lgamma(c + (v + p.alpha)) - SP.lgamma(c + p.alpha))
                       .otherwise(0.0))
    num = total + p.sum_alpha
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + SP.lgamma(num) - SP.lgamma(num + length)


def loo_scores(docs: DataFrame, tables: DataFrame, n_seqs: int, priors: Priors, key: str = "job_id",
               seq: str = "person_id", pos: str = "pos", state: str = "state", vec: str = "x",
               part: str = "topic") -> DataFrame:
    """F11 (``part="topic"``) / F12 (``part="trans"``): each job's log score
    for every candidate state, with the job's own contribution removed from
    the counts (as the sampler sees it).

    ``tables`` are the counts as ``state_tables`` gives them.  A job has a row
    for each state, which meets the state's counts by equi-joins with tables of
    model size; the scores are built-in expressions."""
    states = F.sequence(F.lit(0), F.lit(priors.n_states - 1))
    if part == "topic":
        mass = F.map_from_entries(F.collect_list(F.struct("j", "value")))
        topics = tables.where("kind = 'topic'").groupBy(F.col("i").alias("_s")).agg(mass.alias("_m")).select(
            "_s", F.transform(F.sequence(F.lit(0), F.lit(priors.n_topics - 1)),
                              lambda j: F.coalesce(F.element_at("_m", j), F.lit(0.0))).alias("_c"))
        totals = tables.where("kind = 'total'").select(F.col("i").alias("_s"), F.col("value").alias("_n"))
        d = docs.select(key, F.col(state).cast("int").alias("_z"), F.col(vec).alias("_x"),
                        F.aggregate(vec, F.lit(0.0), lambda a, b: a + b).alias("_l"), F.explode(states).alias("_s"))
        d = d.join(topics, "_s", "left").join(totals, "_s", "left")
        none = F.transform("_x", lambda v: F.lit(0.0))
        own = (F.col("_z") == F.col("_s")).cast("double")
        left = F.zip_with(F.coalesce("_c", none), "_x", lambda c, v: c - own * v)
        score = topic_score(F.col("_x"), F.col("_l"), left, F.coalesce("_n", F.lit(0.0)) - own * F.col("_l"), priors)
        return d.select(key, F.col("_s").alias("state"), F.round(score, 4).alias("loglik"))

    d = _neighbours(docs, seq, pos, state).select(
        key, F.col(state).cast("int").alias("z"), F.col("_prev").cast("int").alias("p"),
        F.col("_next").cast("int").alias("n"), F.explode(states).alias("s"))
    trans = tables.where("kind = 'trans'")
    start = tables.where("kind = 'start'").select(F.col("i").alias("s"), F.col("value").alias("_start"))
    into = trans.select(F.col("i").alias("p"), F.col("j").alias("s"), F.col("value").alias("_into"))
    out = trans.select(F.col("i").alias("s"), F.col("j").alias("n"), F.col("value").alias("_out"))
    tots = trans.groupBy(F.col("i").alias("s")).agg(F.sum("value").alias("_tots"))
    d = d.join(start, "s", "left").join(into, ["p", "s"], "left").join(out, ["s", "n"], "left").join(tots, "s", "left")
    first, last = F.col("p").isNull(), F.col("n").isNull()

    def less(name: str, *own: Column) -> Column:
        """A count without the job's own share of it."""
        return sum((-F.coalesce(c, F.lit(False)).cast("double") for c in own), F.coalesce(name, F.lit(0.0)))

    z, p, n, s = (F.col(c) for c in "zpns")
    at_start = less("_start", first & (s == z))
    in_ = less("_into", ~first & (s == z), ~last & (p == z) & (s == n))
    out_ = less("_out", ~first & (s == p) & (n == z), ~last & (s == z))
    tot = less("_tots", ~last & (s == z))
    g, sum_g, sum_pi = priors.gamma, priors.gamma * priors.n_states, priors.pi * priors.n_states
    lik = F.when(first, (at_start + priors.pi) / (n_seqs - 1 + sum_pi)
                 * F.when(last, 1.0).otherwise((out_ + g) / (tot + sum_g))) \
        .when(last, in_ + g) \
        .when(p == z, (in_ + g) * (out_ + (z == n).cast("double") + g) / (tot + 1 + sum_g)) \
        .otherwise((in_ + g) * (out_ + g) / (tot + sum_g))
    return d.select(key, s.alias("state"), F.round(F.log(lik), 4).alias("loglik"))


# ---------------------------------------------------------------- F13 / F15
def _sweep(bc, seq: str, pos: str, key: str, vec: str, seed: int, it: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, p = bc.value
        for g in whole_sequences(batches, seq):
            X = np.stack([np.asarray(v, dtype=float) for v in g[vec]])
            L = X.sum(axis=1)
            z = g["z"].to_numpy(dtype=np.int64)
            sid = int(g[seq].iloc[0])
            z_new, ch = resample_sequence(z, X, L, c, p, seeded_rng(seed, it, sid))
            out = g[[seq, pos, key, vec]].copy()
            out["z"] = z_new.astype("int32")
            out["changed"] = (z_new != z).astype("int32")
            yield out
    return run


def _first_draws(bc, seq: str, pos: str, key: str, vec: str, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frozen, p = bc.value
        for chunk in whole_sequences(batches, "_chunk"):
            c = frozen.copy()
            for sid, g in chunk.groupby("_no", sort=False):
                X = np.stack([np.asarray(v, dtype=float) for v in g[vec]])
                rng = seeded_rng(seed, -1, int(g[seq].iloc[0]))
                out = g[[seq, pos, key, vec]].copy()
                out["z"] = draw_sequence(X, X.sum(axis=1), c, p, rng).astype("int32")
                yield out
    return run


def init_states(docs: DataFrame, priors: Priors, seed: int, key: str = "job_id", seq: str = "person_id",
                pos: str = "pos", vec: str = "x") -> tuple[DataFrame, Counts]:
    """F13, first pass: every job's state drawn in order, and the counts of
    all draws.

    Histories are numbered by their key.  Block k holds BASE * 2^k of them, so
    that the whole pass is as many jobs as the number of histories has digits;
    its draws see the counts of the blocks before it (read from the drawn
    states by F14) and those of their own chunk.  Block, chunk and generator
    follow from the history, not from its place in the cluster."""
    spark = docs.sparkSession
    ids = docs.select(seq).distinct().withColumn("_all", F.lit(0))
    no = range_row_number(ids, "_all", [F.col(seq)], "_no").select(seq, (F.col("_no") - 1).alias("_no"))
    # block k begins at BASE * (2^k - 1): its number is that of the highest bit
    no = no.withColumn("_block", F.length(F.bin(F.floor(F.col("_no") / BASE) + 1)) - 1) \
           .withColumn("_chunk", F.floor(F.col("_no") / CHUNK))
    path = stage_path(spark, "gibbs_blocks")
    docs.select(seq, pos, key, vec).join(no, seq).write.partitionBy("_block").parquet(path)
    data = spark.read.parquet(path)
    n_seqs, last = no.agg(F.count(F.lit(1)), F.max("_block")).first()
    counts, drawn = Counts.zeros(priors, n_seqs), []
    schema = docs.select(seq, pos, key, vec).schema.add("z", T.IntegerType())
    for k in range((-1 if last is None else last) + 1):
        bc = spark.sparkContext.broadcast((counts, priors))
        block = data.where(F.col("_block") == k).repartition("_chunk").sortWithinPartitions("_chunk", "_no", pos)
        out = stage_path(spark, "gibbs_draws")
        block.select("_chunk", "_no", seq, pos, key, vec).mapInPandas(
            _first_draws(bc, seq, pos, key, vec, seed), schema).write.parquet(out)
        bc.destroy()
        drawn.append(spark.read.schema(schema).parquet(out))
        counts.add(collect_counts(state_tables(drawn[-1], seq, pos, "z", vec), n_seqs, priors.n_states,
                                  priors.n_topics))
    states = spark.createDataFrame([], schema)
    for d in drawn:
        states = states.unionByName(d)
    return states, counts


def fit_gibbs(docs: DataFrame, priors: Priors, n_iter: int, seed: int = 0, key: str = "job_id",
              seq: str = "person_id", pos: str = "pos", vec: str = "x", lag: int = 1,
              checkpoint_every: int = 2, store=None, start_iter: int = 0,
              assignment: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """the first pass in order, then ``n_iter`` sweeps; returns (final
    assignment (seq, pos, key, vec, z), per-sweep share of jobs whose state changed).  With a ``store``
    (a TraceStore), the state tables and assignment are saved every ``lag``
    sweeps and after the last one.  ``assignment`` resumes from saved states."""
    spark = docs.sparkSession
    cur = assignment if assignment is not None else init_states(docs, priors, seed, key, seq, pos, vec)[0]
    cur = by_sequence(cur.select(seq, pos, key, vec, F.col("z").cast("int").alias("z")), seq, pos).checkpoint()
    n_seqs = cur.select(seq).distinct().count()
    n_docs = cur.count()
    rates, held = [], None
    schema = cur.select(seq, pos, key, vec, "z").schema.add("changed", T.IntegerType())
    for it in range(start_iter, start_iter + n_iter):
        counts = collect_counts(state_tables(cur, seq, pos, "z", vec), n_seqs,
                                priors.n_states, priors.n_topics)
        bc = spark.sparkContext.broadcast((counts, priors))
        nxt = cur.mapInPandas(_sweep(bc, seq, pos, key, vec, seed, it), schema)
        # the new assignment keeps the by-sequence layout of its input
        checkpointed = (it - start_iter + 1) % checkpoint_every == 0
        nxt = nxt.checkpoint() if checkpointed else nxt.cache()
        rates.append((nxt.agg(F.sum("changed")).first()[0] or 0) / max(n_docs, 1))
        if held is not None and checkpointed:  # nothing reads the sweeps before a checkpoint again
            held.unpersist()
            held = None
        if not checkpointed:
            held = nxt
        cur = nxt.drop("changed")
        if store is not None and (it % lag == 0 or it == start_iter + n_iter - 1):
            save_iteration(store, cur, it, seq, pos, key, vec)
    return cur, rates


def save_iteration(store, assignment: DataFrame, it: int, seq: str, pos: str, key: str, vec: str) -> None:
    tables = state_tables(assignment, seq, pos, "z", vec).withColumn("iter", F.lit(it))
    states = assignment.select(key, "z").withColumn("iter", F.lit(it))
    store.append({"tables": tables, "states": states})


def resume_gibbs(spark: SparkSession, store, docs: DataFrame, priors: Priors, n_iter: int,
                 seed: int = 0, key: str = "job_id", seq: str = "person_id", pos: str = "pos",
                 vec: str = "x") -> tuple[DataFrame, list[float]]:
    """continue from the last saved sweep: the saved states are joined
    back to the documents and every count table is rebuilt from them (F14)."""
    latest = store.latest(spark, ["tables", "states"])
    last_iter = latest["states"].agg(F.max("iter")).first()[0]
    assign = docs.join(latest["states"].select(key, "z"), key)
    return fit_gibbs(docs, priors, n_iter, seed, key, seq, pos, vec, store=store,
                     start_iter=last_iter + 1, assignment=assign)

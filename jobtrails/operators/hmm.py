"""Discrete-emission hidden Markov model.

The model is the start and transition probabilities (S + S*S numbers, on the
driver) and the emissions, a table with a row for each symbol: neither the
driver nor a task holds states x symbols.

Histories are cut into segments of ``SEGMENT`` positions, and segments into
blocks of about ``BLOCK_TOKENS`` positions.  A block meets the emission rows of
its own symbols in a co-group and runs the scaled recursions over all of its
segments at once, in numpy.  Expected counts leave it as rows (state, symbol,
weight), which ``groupBy`` adds and the next emission table normalises.

A history of many segments is no unit of work either.  Its recursion is a
product of matrices, and products are associative: every segment makes its
transfer matrix, a tree of groups of ``FAN`` segments multiplies them and then
hands down to each segment the distribution that enters it and the weights of
what follows it (for paths: best scores, and the state that the next segment
wants it to end in).  With those, each segment does its local pass exactly.

``pos`` numbers a history's jobs from 1 without gaps (as C6 and E18 do).  A
symbol without an emission row has probability zero in every state; what
follows it in its history then scores ln 1e-300 a position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrails.operators.sequences import range_forward_fill, range_running
from jobtrails.session import stage_path

SEGMENT = 1024           # positions of a segment
BLOCK_TOKENS = 1 << 16   # positions of a block, about
FAN = 256                # segments (or groups of them) that one task multiplies
CELLS = 1 << 22          # numbers of one batch: segments x (padded) positions x states

_TINY = 1e-300


@dataclass
class HmmModel:
    pi: np.ndarray          # (S,)
    A: np.ndarray           # (S, S)
    emissions: DataFrame    # sym, b: probability of the symbol by state
    loglik: list[float] = field(default_factory=list)

    @property
    def n_states(self) -> int:
        return len(self.pi)

    def emission_rows(self) -> DataFrame:
        """i (state), sym, value."""
        return self.emissions.select(F.posexplode("b").alias("i", "value"), "sym").select("i", "sym", "value")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Parameters as a long table (kind, i, j, value)."""
        rows = [("start", int(i), 0, float(v)) for i, v in enumerate(self.pi)]
        rows += [("trans", int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(self.A)]
        small = spark.createDataFrame(rows, "kind string, i int, j int, value double")
        return small.unionByName(self.emission_rows().select(F.lit("emit").alias("kind"), "i",
                                                             F.col("sym").cast("int").alias("j"), "value"))


def save_model(model: HmmModel, path: str) -> None:
    """Emissions and the rest as tables under ``path``."""
    spark = model.emissions.sparkSession
    model.emissions.write.mode("overwrite").parquet(path + "/emissions")
    spark.createDataFrame([(model.pi.tolist(), model.A.ravel().tolist(), [float(x) for x in model.loglik])],
                          "pi array<double>, a array<double>, loglik array<double>"
                          ).write.mode("overwrite").parquet(path + "/chain")


def load_model(spark: SparkSession, path: str) -> HmmModel:
    r = spark.read.parquet(path + "/chain").first()
    n = len(r["pi"])
    return HmmModel(np.array(r["pi"]), np.array(r["a"]).reshape(n, n), spark.read.parquet(path + "/emissions"),
                    list(r["loglik"]))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- layout
@dataclass
class Layout:
    """Encoded histories in segments and blocks, written once."""

    tokens: DataFrame           # block, seq, seg, pos, sym
    terms: DataFrame            # block, sym
    long: DataFrame | None      # block, seq, seg, pos, sym, n_segs: of histories of several segments
    kind: str                   # type of seq


def lay_out(encoded: DataFrame, seq: str = "person_id", pos: str = "seq_pos", sym: str = "id") -> Layout:
    d = encoded.select(F.col(seq).alias("seq"), F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(sym).cast("long"), F.lit(-1)).alias("sym"))
    d = d.withColumn("seg", F.floor((F.col("pos") - 1) / SEGMENT)).transform(lambda x: _written(x, "hmm_tokens"))
    n, longest = d.agg(F.count(F.lit(1)), F.max("seg")).first()
    blocks = -(-n // BLOCK_TOKENS) or 1
    tokens = d.withColumn("block", F.pmod(F.xxhash64("seq", "seg"), F.lit(blocks)))
    terms = _written(tokens.select("block", "sym").distinct(), "hmm_terms")
    long = None
    if longest:
        several = d.where(F.col("seg") > 0).groupBy("seq").agg((F.max("seg") + 1).alias("n_segs"))
        long = _written(tokens.join(several, "seq"), "hmm_long")
    return Layout(tokens, terms, long, encoded.schema[seq].dataType.simpleString())


def _side(layout: Layout, terms: DataFrame, model: HmmModel, bounds: DataFrame | None) -> DataFrame:
    """What a block needs next to its tokens: emission rows (sym, v) and, where
    its segments belong to longer histories (``bound``), what enters and
    follows them (seq, seg, v).  Columns that don't apply hold zeros, as a null
    would make pandas turn whole numbers into floats."""
    own = terms.select(F.col("block").alias("block"), F.col("sym").alias("_s")).join(model.emissions, F.col("_s") == F.col("sym"))
    none = F.lit(0).cast("bigint")
    side = own.select("block", F.lit(False).alias("bound"), F.lit(0).cast(layout.kind).alias("seq"), none.alias("seg"),
                      F.col("sym").cast("bigint").alias("sym"), F.col("b").alias("v"))
    if bounds is not None:
        side = side.unionByName(bounds.select("block", F.lit(True).alias("bound"), "seq", "seg", none.alias("sym"), "v"))
    return side


def _per_block(layout: Layout, tokens: DataFrame, model: HmmModel, bounds: DataFrame | None, fn: Callable,
               schema: str) -> DataFrame:
    """``fn(batch)`` over the padded batches of every block's segments; it
    yields pandas frames of ``schema``."""
    terms = layout.terms if tokens is layout.tokens else tokens.select("block", "sym").distinct()
    side = _side(layout, terms, model, bounds)
    n, names = model.n_states, [c.split()[0] for c in schema.split(", ")]

    def run(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = [x for b in _batches(mine, other, n) for x in fn(b)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    columns = ["block", "seq", "seg", "pos", "sym", *(["n_segs"] if "n_segs" in tokens.columns else [])]
    return tokens.select(*columns).groupBy("block").cogroup(side.groupBy("block")).applyInPandas(run, schema)


@dataclass
class Batch:
    obs: np.ndarray          # (N, T) rows of Bt, padded
    lens: np.ndarray         # (N,)
    Bt: np.ndarray           # (V + 1, S): emissions of the block's symbols, then zeros
    syms: np.ndarray         # (V,)
    seq: np.ndarray
    seg: np.ndarray
    pos: np.ndarray          # position of the first of each segment
    bounds: list             # what enters and follows a segment of a longer history, else None
    n_segs: np.ndarray | None

    @property
    def mask(self) -> np.ndarray:
        return np.arange(self.obs.shape[1])[None, :] < self.lens[:, None]


def _batches(mine: pd.DataFrame, other: pd.DataFrame, n: int) -> Iterator[Batch]:
    if not len(mine):
        return
    mine = mine.sort_values(["seq", "seg", "pos"], kind="stable")
    bound = other["bound"].to_numpy(bool)
    rows = other[~bound].sort_values("sym")
    syms = rows["sym"].to_numpy(np.int64)
    Bt = np.vstack([np.stack(rows["v"].to_numpy()) if len(rows) else np.zeros((0, n)), np.zeros((1, n))])
    sym = mine["sym"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(syms, sym), max(len(syms) - 1, 0))
    at = np.where(syms[at] == sym, at, len(syms)) if len(syms) else np.zeros(len(sym), np.int64)
    given = {(r.seq, r.seg): np.asarray(r.v) for r in other[bound].itertuples()}
    seq, seg, pos = (mine[c].to_numpy() for c in ("seq", "seg", "pos"))
    first = np.flatnonzero(np.concatenate([[True], (seq[1:] != seq[:-1]) | (seg[1:] != seg[:-1])]))
    lens = np.diff(np.concatenate([first, [len(seq)]]))
    n_segs = mine["n_segs"].to_numpy()[first] if "n_segs" in mine else None
    order, a = np.argsort(-lens, kind="stable"), 0
    while a < len(order):
        z = min(len(order), a + max(1, CELLS // (n * max(n, int(lens[order[a]])))))
        some = order[a:z]
        obs = np.full((len(some), int(lens[some[0]])), len(syms), np.int64)
        for k, i in enumerate(some):
            obs[k, :lens[i]] = at[first[i]:first[i] + lens[i]]
        head = first[some]
        yield Batch(obs, lens[some], Bt, syms, seq[head], seg[head].astype(np.int64), pos[head].astype(np.int64),
                    [given.get((seq[i], seg[i])) for i in head], None if n_segs is None else n_segs[some])
        a = z


# ---------------------------------------------------------------- recursions
def forward(b: Batch, pi: np.ndarray, A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward pass: filtered distributions (N, T, S) and scales (N, T)."""
    n, T = b.obs.shape
    S = len(pi)
    prior = np.tile(pi, (n, 1))
    for i, v in enumerate(b.bounds):
        if v is not None and b.seg[i] > 0:
            prior[i] = v[:S] @ A
    alpha, c = np.zeros((n, T, S)), np.ones((n, T))
    for t in range(T):
        act = b.lens > t
        a = (prior if t == 0 else alpha[act, t - 1] @ A) * b.Bt[b.obs[act, t]]
        c[act, t] = s = np.maximum(a.sum(axis=1), _TINY)
        alpha[act, t] = a / s[:, None]
    return alpha, c


def backward(b: Batch, alpha: np.ndarray, c: np.ndarray, A: np.ndarray) -> np.ndarray:
    """Scaled backward pass (N, T, S), so that alpha * beta sums to one."""
    n, T, S = alpha.shape
    beta = np.zeros((n, T, S))
    last = b.lens - 1
    end = np.ones((n, S))
    for i, v in enumerate(b.bounds):
        if v is not None:
            end[i] = v[S:]
    total = (alpha[np.arange(n), last] * end).sum(axis=1)[:, None]
    end = np.where(total > 0, end / np.where(total > 0, total, 1.0), 0.0)
    beta[np.arange(n), last] = end
    for t in range(T - 2, -1, -1):
        act = b.lens > t + 1
        beta[act, t] = ((b.Bt[b.obs[act, t + 1]] * beta[act, t + 1]) @ A.T) / c[act, t + 1, None]
    return beta


def expected_counts(b: Batch, pi: np.ndarray, A: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, starts, transitions, emissions by row of Bt) of a batch."""
    alpha, c = forward(b, pi, A)
    beta = backward(b, alpha, c, A)
    gamma = alpha * beta
    S, mask = len(pi), b.mask
    trans = np.zeros((S, S))
    for t in range(1, b.obs.shape[1]):
        act = b.lens > t
        trans += (alpha[act, t - 1].T @ (b.Bt[b.obs[act, t]] * beta[act, t] / c[act, t, None])) * A
    inner = np.flatnonzero(b.seg > 0)   # the step from the segment before belongs to this one
    if len(inner):
        into = np.stack([b.bounds[i][:S] for i in inner])
        trans += (into.T @ (b.Bt[b.obs[inner, 0]] * beta[inner, 0] / c[inner, 0, None])) * A
    emit = np.zeros((len(b.Bt), S))
    np.add.at(emit, b.obs[mask], gamma[mask])
    return float(np.log(c[mask]).sum()), gamma[b.seg == 0, 0].sum(axis=0), trans, emit


def best_path(b: Batch, pi: np.ndarray, A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-product pass: scores of the last position by state (N, S) and
    back-pointers (T, N, S); that of the first position points into the segment
    before (itself where there is none)."""
    n, T = b.obs.shape
    S = len(pi)
    with np.errstate(divide="ignore"):
        lA, lB, lpi = np.log(A), np.log(b.Bt), np.log(pi)
    back = np.zeros((T, n, S), np.int32)
    back[0] = np.arange(S)
    d = np.tile(lpi, (n, 1))
    for i, v in enumerate(b.bounds):
        if v is not None and b.seg[i] > 0:
            m = v[:S, None] + lA
            back[0, i], d[i] = m.argmax(axis=0), m.max(axis=0)
    d = d + lB[b.obs[:, 0]]
    for t in range(1, T):
        act = np.flatnonzero(b.lens > t)
        m = d[act][:, :, None] + lA[None, :, :]
        back[t, act] = m.argmax(axis=1)
        d[act] = m.max(axis=1) + lB[b.obs[act, t]]
    return d, back


# ---------------------------------------------------------------- long histories
def transfer(b: Batch, pi: np.ndarray, A: np.ndarray, best: bool) -> np.ndarray:
    """(N, S, S): how the state before a segment leads to each state at its end,
    up to a factor.  A history's first segment leads there from its starts."""
    n, T = b.obs.shape
    S = len(pi)
    step = np.where((b.seg == 0)[:, None, None], np.broadcast_to(pi, (S, S)), A)
    if not best:
        m = step * b.Bt[b.obs[:, 0]][:, None, :]
        for t in range(1, T):
            act = b.lens > t
            m[act] = (m[act] @ A) * b.Bt[b.obs[act, t]][:, None, :]
            m[act] /= np.maximum(m[act].max(axis=(1, 2), keepdims=True), _TINY)
        return m
    with np.errstate(divide="ignore"):
        lA, lB = np.log(A), np.log(b.Bt)
        m = np.log(step) + lB[b.obs[:, 0]][:, None, :]
    for t in range(1, T):
        act = np.flatnonzero(b.lens > t)
        new = np.full((len(act), S, S), -np.inf)
        for k in range(S):
            np.maximum(new, m[act, :, k, None] + lA[k], out=new)
        m[act] = new + lB[b.obs[act, t]][:, None, :]
    return m


class Sums:
    """Products of probabilities: what enters a segment, and what follows it."""

    @staticmethod
    def product(ms: list[np.ndarray]) -> np.ndarray:
        m = ms[0]
        for x in ms[1:]:
            m = m @ x
            m = m / max(m.max(), _TINY)
        return m

    @staticmethod
    def start(s: int) -> np.ndarray:
        return np.concatenate([np.full(s, 1 / s), np.ones(s)])

    @staticmethod
    def sweep(ms: list[np.ndarray], v: np.ndarray) -> list[np.ndarray]:
        s = len(v) // 2
        into, after = [v[:s]], [v[s:]]
        for m in ms[:-1]:
            x = into[-1] @ m
            into.append(x / max(x.sum(), _TINY))
        for m in ms[:0:-1]:
            x = m @ after[-1]
            after.append(x / max(x.max(), _TINY))
        return [np.concatenate(x) for x in zip(into, reversed(after))]


class Maxima:
    """Products of best scores: the best score of each state before a segment."""

    @staticmethod
    def product(ms: list[np.ndarray]) -> np.ndarray:
        m = ms[0]
        for x in ms[1:]:
            m = (m[:, :, None] + x[None]).max(axis=1)
        return m

    @staticmethod
    def start(s: int) -> np.ndarray:
        return np.zeros(s)

    @staticmethod
    def sweep(ms: list[np.ndarray], v: np.ndarray) -> list[np.ndarray]:
        out = [v]
        for m in ms[:-1]:
            out.append((out[-1][:, None] + m).max(axis=0))
        return out


class Ends:
    """Maps from the end state of a segment to that of the one before it; each
    matrix has the map in its first row."""

    @staticmethod
    def product(ms: list[np.ndarray]) -> np.ndarray:
        f = ms[-1][0]
        for x in ms[-2::-1]:
            f = x[0][f.astype(int)]
        return np.tile(f, (len(f), 1))

    @staticmethod
    def start(s: int) -> np.ndarray:
        return np.zeros(1)  # the last segment's own choice, see decode_paths

    @staticmethod
    def sweep(ms: list[np.ndarray], v: np.ndarray) -> list[np.ndarray]:
        out = [v]
        for m in ms[:0:-1]:
            out.append(m[0][out[-1].astype(int)])
        return out[::-1]


def scan(mats: DataFrame, kind: type, n: int, seq_type: str) -> DataFrame:
    """seq, seg, v: what ``kind`` hands to every segment of the table (seq, seg,
    m: n * n numbers).  Up a tree of groups of FAN by products, then down it by
    sweeps; a history of FAN^k segments takes k levels, and no task has more
    than FAN matrices of one."""
    def mat(rows: pd.DataFrame) -> list[np.ndarray]:
        return [np.asarray(x).reshape(-1, n) for x in rows.sort_values("seg")["m"]]

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seq": [key[0]], "seg": [key[1]], "m": [kind.product(mat(rows)).ravel()]})

    def handed(rows: pd.DataFrame, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"seq": rows["seq"].iloc[0], "seg": np.sort(rows["seg"].to_numpy()),
                             "v": kind.sweep(mat(rows), v)})

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        return handed(rows, kind.start(n))

    def down(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return handed(rows, np.asarray(above["v"].iloc[0]))

    levels = [mats]
    while (levels[-1].groupBy("seq").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > FAN:
        group = F.floor(F.col("seg") / FAN).alias("group")
        levels.append(_written(levels[-1].groupBy("seq", group).applyInPandas(
            up, f"seq {seq_type}, seg bigint, m array<double>"), "hmm_products"))
    schema = f"seq {seq_type}, seg bigint, v array<double>"
    found = levels[-1].groupBy("seq").applyInPandas(top, schema)
    for level in levels[-2::-1]:
        found = _written(found, "hmm_handed")
        found = level.groupBy("seq", F.floor(F.col("seg") / FAN).alias("group")).cogroup(
            found.groupBy("seq", F.col("seg").alias("group"))).applyInPandas(down, schema)
    return found


def _bounds(layout: Layout, model: HmmModel, best: bool) -> DataFrame | None:
    """block, seq, seg, v for the segments of histories with several."""
    if layout.long is None:
        return None
    pi, A = model.pi, model.A

    def run(b: Batch):
        yield pd.DataFrame({"seq": b.seq, "seg": b.seg, "m": [m.ravel() for m in transfer(b, pi, A, best)]})

    mats = _written(_per_block(layout, layout.long, model, None, run, f"seq {layout.kind}, seg bigint, m array<double>"),
                    "hmm_transfer")
    return _in_blocks(layout, scan(mats, Maxima if best else Sums, model.n_states, layout.kind))


def _in_blocks(layout: Layout, found: DataFrame) -> DataFrame:
    blocks = layout.long.select(*[F.col(c).alias(c) for c in ("seq", "seg", "block")]).distinct()
    return _written(found.join(blocks, ["seq", "seg"]), "hmm_bounds")


# ---------------------------------------------------------------- F8
def _normalise(m: np.ndarray) -> np.ndarray:
    s = m.sum(axis=-1, keepdims=True)
    return np.where(s > 0, m / np.where(s > 0, s, 1.0), 1.0 / m.shape[-1])


def init_model(symbols: DataFrame, n_states: int, seed: int) -> HmmModel:
    """Uniform starts and transitions; emissions drawn from a hash of symbol and
    state, each state's row normalised.  ``symbols`` has one column ``sym``."""
    draw = [((F.pmod(F.xxhash64("sym", F.lit(i), F.lit(seed)), F.lit(1 << 30)) + 1) / float(1 << 30)).alias(f"c{i}")
            for i in range(n_states)]
    return HmmModel(np.full(n_states, 1 / n_states), np.full((n_states, n_states), 1 / n_states),
                    _emission_table(symbols.select("sym", *draw), n_states))


def _emission_table(weights: DataFrame, n_states: int) -> DataFrame:
    """sym, b from weights (sym, c0, c1, ...) by state; a state without any is uniform."""
    *totals, v = weights.agg(*[F.sum(f"c{i}") for i in range(n_states)], F.count(F.lit(1))).first()
    return weights.select("sym", F.array(*[F.col(f"c{i}") / F.lit(t) if t else F.lit(1 / max(v, 1))
                                           for i, t in enumerate(totals)]).alias("b"))


def em_step(layout: Layout, model: HmmModel) -> HmmModel:
    """One Baum-Welch step over all histories."""
    n = model.n_states
    pi, A = model.pi, model.A

    def run(b: Batch):
        ll, start, trans, emit = expected_counts(b, pi, A)
        some = np.flatnonzero(emit[:-1].any(axis=1))
        kinds = ["emit"] * len(some) + ["start"] + ["trans"] * n + ["loglik"]
        rows = np.concatenate([emit[some], start[None], trans, np.full((1, n), ll)])
        yield pd.DataFrame({"kind": kinds, "sym": np.concatenate([b.syms[some], [0], np.arange(n), [0]]),
                            **{f"c{i}": rows[:, i] for i in range(n)}})

    schema = "kind string, sym bigint, " + ", ".join(f"c{i} double" for i in range(n))
    parts = _per_block(layout, layout.tokens, model, _bounds(layout, model, best=False), run, schema)
    stats = _written(parts.groupBy("kind", "sym").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]), "hmm_counts")
    start, trans, ll = np.zeros(n), np.zeros((n, n)), 0.0
    for r in stats.where("kind != 'emit'").collect():  # n + 2 rows
        row = [r[f"c{i}"] for i in range(n)]
        if r["kind"] == "start":
            start[:] = row
        elif r["kind"] == "trans":
            trans[r["sym"]] = row
        else:
            ll = row[0]
    return HmmModel(_normalise(start), _normalise(trans), _emission_table(stats.where("kind = 'emit'").drop("kind"), n),
                    [*model.loglik, ll])


def fit_em(encoded: DataFrame, n_states: int, n_iter: int = 15, seed: int = 0, seq: str = "person_id",
           pos: str = "seq_pos", sym: str = "id", model: HmmModel | None = None) -> HmmModel:
    """F8: Baum-Welch over (seq, pos, symbol id), from ``model`` or a random start."""
    layout = lay_out(encoded, seq, pos, sym)
    model = model or init_model(layout.terms.select("sym").distinct(), n_states, seed)
    for _ in range(n_iter):
        model = em_step(layout, model)
    return model


# ---------------------------------------------------------------- F9, F10
def score(model: HmmModel, encoded: DataFrame, seq: str = "person_id", pos: str = "seq_pos",
          sym: str = "id") -> DataFrame:
    """log-likelihood of every sequence (sum them for the corpus score)."""
    layout = lay_out(encoded, seq, pos, sym)
    pi, A = model.pi, model.A

    def run(b: Batch):
        _, c = forward(b, pi, A)
        yield pd.DataFrame({"seq": b.seq, "loglik": np.where(b.mask, np.log(c), 0.0).sum(axis=1)})

    parts = _per_block(layout, layout.tokens, model, _bounds(layout, model, best=False), run,
                       f"seq {layout.kind}, loglik double")
    return parts.groupBy(F.col("seq").alias(seq)).agg(F.sum("loglik").alias("loglik"))


def decode_paths(model: HmmModel, encoded: DataFrame, seq: str = "person_id", pos: str = "seq_pos",
                 sym: str = "id") -> DataFrame:
    """the most likely state at every position: seq, pos, state, and
    whether the position is the history's last."""
    layout = lay_out(encoded, seq, pos, sym)
    pi, A = model.pi, model.A
    S = model.n_states
    bounds = _bounds(layout, model, best=True)
    if bounds is not None:
        def ends(b: Batch):
            """For every end state of a segment, that of the segment before; the
            last segment ends in its best state, whatever it is told."""
            d, back = best_path(b, pi, A)
            rows = []
            for i in range(len(b.seq)):
                s = np.arange(S) if b.seg[i] < b.n_segs[i] - 1 else np.full(S, d[i].argmax())
                own = s.copy()
                for t in range(b.lens[i] - 1, -1, -1):
                    s = back[t, i, s]
                rows.append((s, own))
            yield pd.DataFrame({"seq": b.seq, "seg": b.seg, "m": [np.tile(s, (S, 1)).ravel().astype(float) for s, _ in rows],
                                "last": b.seg == b.n_segs - 1, "end": [int(own[0]) for _, own in rows]})

        maps = _written(_per_block(layout, layout.long, model, bounds, ends,
                                   f"seq {layout.kind}, seg bigint, m array<double>, last boolean, end bigint"), "hmm_maps")
        wanted = scan(maps.select("seq", "seg", "m"), Ends, S, layout.kind)
        # the last segment has nobody to tell it where to end
        wanted = wanted.join(maps.select("seq", "seg", "last", "end"), ["seq", "seg"]).select(
            "seq", "seg", F.when(F.col("last"), F.col("end").cast("double")).otherwise(F.col("v")[0]).alias("end"))
        bounds = _written(bounds.join(wanted, ["seq", "seg"]).withColumn("v", F.concat("v", F.array("end"))).drop("end"),
                          "hmm_bounds")

    tail = None if layout.long is None else layout.long.groupBy("seq").agg(F.max("n_segs").alias("n_segs"))

    def run(b: Batch):
        d, back = best_path(b, pi, A)
        n, T = b.obs.shape
        path = np.zeros((n, T), np.int32)
        state = np.array([int(v[S]) if v is not None else x.argmax() for v, x in zip(b.bounds, d)])
        for t in range(T - 1, -1, -1):
            act = b.lens > t
            path[act, t] = state[act]
            state[act] = back[t, act, state[act]]
        mask, at = b.mask, np.arange(T)[None, :]
        yield pd.DataFrame({"seq": np.repeat(b.seq, b.lens), "pos": (b.pos[:, None] + at)[mask], "state": path[mask],
                            "seg": np.repeat(b.seg, b.lens), "is_last": (at == b.lens[:, None] - 1)[mask]})

    found = _per_block(layout, layout.tokens, model, bounds, run,
                       f"seq {layout.kind}, pos bigint, state int, seg bigint, is_last boolean")
    if tail is not None:
        found = found.join(tail, "seq", "left").withColumn(
            "is_last", F.col("is_last") & (F.col("seg") == F.coalesce(F.col("n_segs"), F.lit(1)) - 1))
    return found.select(F.col("seq").alias(seq), F.col("pos").alias(pos), "state", "is_last")


def draw_symbols(model: HmmModel, asked: DataFrame, seq: str, state: str, seed: int) -> DataFrame:
    """seq, sym: for each row a symbol drawn from its state's emissions, by a
    number in [0, 1) that hashes (seed, seq): cumulative emissions and numbers
    are sorted together over ranges, and each number takes the symbol whose
    interval it falls into."""
    cum = range_running(model.emission_rows().where("value > 0"), "i", ["sym"], {"at": F.col("value")})
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(seq)), F.lit(1 << 53)) / float(1 << 53)
    marks = cum.select("i", "at", F.lit(0).alias("kind"), "sym", F.lit(None).cast(asked.schema[seq].dataType).alias(seq))
    top = cum.groupBy("i").agg(F.max("at_total").alias("total"))
    calls = asked.join(top, F.col(state) == F.col("i")).select(
        "i", (u * F.col("total")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("sym"), seq)
    filled = range_forward_fill(marks.unionByName(calls), "i", ["at", "kind"], {"_sym": F.col("sym")})
    return filled.where("kind = 1").select(seq, F.col("_sym").alias("sym"))


def decode_next(model: HmmModel, encoded: DataFrame, seq: str = "person_id", pos: str = "seq_pos",
                sym: str = "id", draw_seed: int | None = None) -> DataFrame:
    """the last state of each sequence's most likely path; the next state is
    the arg-max of that state's transition row, the predicted symbol the arg-max
    of the next state's emissions (the least id on ties) -- or, with
    ``draw_seed``, a draw from them that depends on seed and sequence only."""
    last = decode_paths(model, encoded, seq, pos, sym).where("is_last").select(seq, F.col("state").alias("last_state"))
    after = F.array(*[F.lit(int(x)) for x in model.A.argmax(axis=1)])
    out = last.withColumn("next_state", F.element_at(after, F.col("last_state") + 1))
    if draw_seed is None:
        best = model.emission_rows().groupBy("i").agg(F.max_by("sym", F.struct("value", -F.col("sym"))).alias("next_id"))
        out = out.join(best, F.col("next_state") == F.col("i"), "left").drop("i")
    else:
        out = out.transform(lambda x: _written(x, "hmm_last"))
        drawn = draw_symbols(model, out, seq, "next_state", draw_seed).withColumnRenamed("sym", "next_id")
        out = out.join(drawn, seq, "left")
    return out.select(seq, "last_state", "next_state", "next_id")

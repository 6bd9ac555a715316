"""Invariants and small-truth checks for the iterative models."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtrails.operators import gibbs as GB
from jobtrails.operators import hmm as HM
from jobtrails.operators import topics as TOP
from tests.conftest import SF01


def _sample_hmm(n_seqs, rng, pi, A, B, lo=2, hi=9):
    rows = []
    for s in range(n_seqs):
        T = int(rng.integers(lo, hi))
        z = rng.choice(len(pi), p=pi)
        for t in range(T):
            rows.append((s, t + 1, int(rng.choice(B.shape[1], p=B[z]))))
            z = rng.choice(len(pi), p=A[z])
    return rows


TRUE_PI = np.array([0.6, 0.3, 0.1])
TRUE_A = np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]])
TRUE_B = np.array([[0.7, 0.2, 0.05, 0.05], [0.05, 0.7, 0.2, 0.05], [0.05, 0.05, 0.2, 0.7]])


def plain_counts(obs, pi, A, B):
    """Textbook scaled forward-backward of one sequence: log-likelihood, state
    posteriors, summed transition posteriors."""
    T, S = len(obs), len(pi)
    alpha, c = np.empty((T, S)), np.empty(T)
    for t in range(T):
        a = (pi if t == 0 else alpha[t - 1] @ A) * B[:, obs[t]]
        c[t] = a.sum()
        alpha[t] = a / c[t]
    beta, xi = np.ones((T, S)), np.zeros((S, S))
    for t in range(T - 2, -1, -1):
        bb = B[:, obs[t + 1]] * beta[t + 1]
        beta[t] = A @ bb / c[t + 1]
        xi += np.outer(alpha[t], bb) * A / c[t + 1]
    return np.log(c).sum(), alpha * beta, xi


def plain_path(obs, pi, A, B):
    d, back = np.log(pi) + np.log(B[:, obs[0]]), []
    for o in obs[1:]:
        m = d[:, None] + np.log(A)
        back.append(m.argmax(axis=0))
        d = m.max(axis=0) + np.log(B[:, o])
    path = [int(d.argmax())]
    for k in reversed(back):
        path.append(int(k[path[-1]]))
    return path[::-1]


def test_plain_recursions_match_brute_force():
    rng = np.random.default_rng(0)
    for T in range(1, 5):
        obs = rng.integers(0, 4, size=T)
        paths = list(itertools.product(range(3), repeat=T))
        probs = []
        for path in paths:
            p = TRUE_PI[path[0]] * TRUE_B[path[0], obs[0]]
            for t in range(1, T):
                p *= TRUE_A[path[t - 1], path[t]] * TRUE_B[path[t], obs[t]]
            probs.append(p)
        ll, gamma, xi = plain_counts(obs, TRUE_PI, TRUE_A, TRUE_B)
        assert ll == pytest.approx(np.log(sum(probs)), rel=1e-10)
        assert tuple(plain_path(obs, TRUE_PI, TRUE_A, TRUE_B)) == paths[int(np.argmax(probs))]
        post0 = np.zeros(3)
        for path, p in zip(paths, probs):
            post0[path[0]] += p
        assert np.allclose(gamma[0], post0 / sum(probs)) and xi.sum() == pytest.approx(T - 1)


def true_model(spark):
    rows = [(o, TRUE_B[:, o].tolist()) for o in range(4)]
    return HM.HmmModel(TRUE_PI, TRUE_A, spark.createDataFrame(rows, "sym bigint, b array<double>"))


@pytest.mark.parametrize("segment,lengths", [(1024, [1, 2, 9, 30]), (16, [1200, 1, 16, 17, 33, 250, 64])])
def test_distributed_recursions_match_plain_ones(spark, monkeypatch, segment, lengths):
    """Histories of one segment, and of up to 75 in a tree of four levels whose
    rows come from 50 partitions in many blocks."""
    monkeypatch.setattr(HM, "SEGMENT", segment)
    monkeypatch.setattr(HM, "FAN", 4)
    monkeypatch.setattr(HM, "BLOCK_TOKENS", 100)
    rng = np.random.default_rng(8)
    seqs = {2**60 + i: rng.integers(0, 4, size=n) for i, n in enumerate(lengths)}
    df = spark.createDataFrame([(k, t + 1, int(o)) for k, obs in seqs.items() for t, o in enumerate(obs)],
                               "person_id long, seq_pos long, id long").repartition(50)
    # no two products of these are equal, so that every best path is the only one
    pi, A, B = (x / x.sum(axis=-1, keepdims=True) for x in (TRUE_PI + rng.random(3) / 9, TRUE_A + rng.random((3, 3)) / 9,
                                                            TRUE_B + rng.random((3, 4)) / 9))
    model = HM.HmmModel(pi, A, spark.createDataFrame([(o, B[:, o].tolist()) for o in range(4)], "sym bigint, b array<double>"))
    want = {k: plain_counts(o, pi, A, B) for k, o in seqs.items()}
    got = {r["person_id"]: r["loglik"] for r in HM.score(model, df).collect()}
    assert got == pytest.approx({k: w[0] for k, w in want.items()}, rel=1e-9)

    new = HM.fit_em(df, 3, n_iter=1, model=model)
    start = sum(w[1][0] for w in want.values())
    trans = sum(w[2] for w in want.values())
    emit = np.zeros((3, 4))
    for k, w in want.items():
        np.add.at(emit.T, seqs[k], w[1])
    assert np.allclose(new.pi, start / start.sum()) and np.allclose(new.A, trans / trans.sum(axis=1, keepdims=True))
    b = {r["sym"]: r["b"] for r in new.emissions.collect()}
    assert np.allclose([b[o] for o in range(4)], (emit / emit.sum(axis=1, keepdims=True)).T)
    assert new.loglik == pytest.approx([sum(w[0] for w in want.values())])

    paths = {}
    for r in HM.decode_paths(model, df).collect():
        paths.setdefault(r["person_id"], []).append((r["seq_pos"], r["state"], r["is_last"]))
    for k, obs in seqs.items():
        found = sorted(paths[k])
        assert [x[1] for x in found] == plain_path(obs, pi, A, B)
        assert [x[2] for x in found] == [False] * (len(obs) - 1) + [True]
    nxt = {r["person_id"]: (r["last_state"], r["next_state"], r["next_id"]) for r in HM.decode_next(model, df).collect()}
    for k, obs in seqs.items():
        last = plain_path(obs, pi, A, B)[-1]
        assert nxt[k] == (last, A[last].argmax(), B[A[last].argmax()].argmax())


def test_hmm_of_unseen_symbols_text_keys_and_empty_tables(spark, tmp_path):
    HM.save_model(true_model(spark), str(tmp_path / "m"))
    model = HM.load_model(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 99), ("b", 1, None), ("c", 1, 3)], "p string, seq_pos long, id long")
    got = {r["p"]: r["loglik"] for r in HM.score(model, df, seq="p").collect()}
    assert got["c"] == pytest.approx(np.log(TRUE_PI @ TRUE_B[:, 3]))
    assert got["b"] == pytest.approx(np.log(1e-300)) and got["a"] < np.log(1e-300) + 1
    assert HM.decode_next(model, df, seq="p").count() == 3
    none = df.limit(0)
    assert HM.score(model, none, seq="p").collect() == [] and HM.decode_next(model, none, seq="p").collect() == []
    fitted = HM.fit_em(none, 2, n_iter=1, seq="p")
    assert fitted.emissions.collect() == [] and np.allclose(fitted.A.sum(axis=1), 1)


def test_drawn_symbols_follow_the_emissions(spark):
    model = true_model(spark)
    asked = spark.range(6000).select(F.col("id").alias("person_id"), (F.col("id") % 3).cast("int").alias("s"))
    got = HM.draw_symbols(model, asked, "person_id", "s", 7).join(asked, "person_id").groupBy("s", "sym").count().collect()
    share = np.zeros((3, 4))
    for r in got:
        share[r["s"], r["sym"]] = r["count"] / 2000
    assert np.abs(share - TRUE_B).max() < 0.04


def test_em_monotone_and_beats_shuffled(spark):
    rng = np.random.default_rng(1)
    rows = _sample_hmm(300, rng, TRUE_PI, TRUE_A, TRUE_B)
    df = spark.createDataFrame(rows, "person_id long, seq_pos long, id long")
    model = HM.fit_em(df, 3, n_iter=12, seed=2)
    ll = np.array(model.loglik)
    assert np.all(np.diff(ll) > -1e-6), ll
    B = np.array([r["b"] for r in model.emissions.collect()]).T
    for m in (model.pi[None, :], model.A, B):
        assert np.allclose(m.sum(axis=1), 1.0)
    held = _sample_hmm(100, np.random.default_rng(9), TRUE_PI, TRUE_A, TRUE_B)
    hdf = spark.createDataFrame(held, "person_id long, seq_pos long, id long")
    good = HM.score(model, hdf).agg(F.sum("loglik")).first()[0]
    # same symbols, order shuffled within each sequence: the fitted chain should prefer the real order
    by = {}
    for s, t, o in held:
        by.setdefault(s, []).append(o)
    srng = np.random.default_rng(4)
    shuffled = [(s, i + 1, int(o)) for s, obs in by.items() for i, o in enumerate(srng.permutation(obs))]
    bad = HM.score(model, spark.createDataFrame(shuffled, "person_id long, seq_pos long, id long")) \
            .agg(F.sum("loglik")).first()[0]
    assert good > bad
    nxt = HM.decode_next(model, hdf).collect()
    assert len(nxt) == 100 and all(0 <= r["next_state"] < 3 for r in nxt)
    d1 = sorted(tuple(r) for r in HM.decode_next(model, hdf, draw_seed=5).collect())
    d2 = sorted(tuple(r) for r in HM.decode_next(model, hdf.repartition(3), draw_seed=5).collect())
    assert d1 == d2 and all(0 <= r[3] < 4 for r in d1)


def _gibbs_fixture(spark, n_seqs=40, seed=0):
    rng = np.random.default_rng(seed)
    rows, job = [], 0
    for s in range(n_seqs):
        n = int(rng.integers(1, 6))            # includes one-job histories
        for t in range(n):
            x = rng.gamma(0.5, 2.0, size=6)
            rows.append((job, s, t, int(rng.integers(0, 4)), [float(v) for v in x]))
            job += 1
    return spark.createDataFrame(rows, "job_id long, person_id long, pos long, state int, x array<double>")


def test_state_table_invariants(spark):
    docs = _gibbs_fixture(spark)
    pri = GB.Priors(4, 6)
    final, rates = GB.fit_gibbs(docs, pri, n_iter=2, seed=3)
    t = {(r["kind"], r["i"], r["j"]): r["value"] for r in GB.state_tables(final, state="z").collect()}
    n_seqs = docs.select("person_id").distinct().count()
    n_docs = docs.count()
    starts = sum(v for (k, _, _), v in t.items() if k == "start")
    trans = sum(v for (k, _, _), v in t.items() if k == "trans")
    totals = sum(v for (k, _, _), v in t.items() if k == "total")
    length = docs.select(F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("l")).agg(F.sum("l")).first()[0]
    assert starts == n_seqs and trans == n_docs - n_seqs
    assert totals == pytest.approx(length)
    assert len(rates) == 2 and all(0 <= r <= 1 for r in rates)


def test_gibbs_independent_of_partitioning(spark, monkeypatch):
    """First pass and ten sweeps, bit for bit."""
    monkeypatch.setattr(GB, "BASE", 8)
    monkeypatch.setattr(GB, "CHUNK", 4)
    docs = _gibbs_fixture(spark, seed=5)
    pri = GB.Priors(4, 6)

    def fit(n):
        final, rates = GB.fit_gibbs(docs.repartition(n), pri, n_iter=10, seed=11)
        tables = GB.state_tables(final, state="z").collect()
        return {r["job_id"]: r["z"] for r in final.select("job_id", "z").collect()}, rates, sorted(map(tuple, tables))

    assert fit(2) == fit(5) == fit(13)


def test_first_pass_in_order(spark, monkeypatch):
    """The distributed pass against a plain loop over blocks, chunks and
    histories; its counts are those of its states."""
    monkeypatch.setattr(GB, "BASE", 4)
    monkeypatch.setattr(GB, "CHUNK", 2)
    docs = _gibbs_fixture(spark, seed=7)
    pri = GB.Priors(4, 6)
    states, counts = GB.init_states(docs.repartition(5), pri, seed=3)
    got = {r["job_id"]: r["z"] for r in states.collect()}

    by = {}
    for r in sorted(docs.collect(), key=lambda r: (r["person_id"], r["pos"])):
        by.setdefault(r["person_id"], []).append(r)
    people = sorted(by)
    want, total, first = {}, GB.Counts.zeros(pri, len(people)), 0
    while first < len(people):
        size = first + 4                       # 4, 8, 16, ...
        new = GB.Counts.zeros(pri, len(people))
        for a in range(first, min(first + size, len(people)), 2):
            c = total.copy()
            for person in people[a:min(a + 2, first + size)]:
                X = np.array([r["x"] for r in by[person]])
                z = GB.draw_sequence(X, X.sum(axis=1), c, pri, GB.seeded_rng(3, -1, person))
                want |= {r["job_id"]: int(s) for r, s in zip(by[person], z)}
                new.start[z[0]] += 1
                np.add.at(new.trans, (z[:-1], z[1:]), 1)
                np.add.at(new.topics, z, X.round(12))
                np.add.at(new.totals, z, X.sum(axis=1))
        new.tots = new.trans.sum(axis=1)
        total.add(new)
        first += size
    assert got == want
    for name in ("start", "trans", "tots", "topics", "totals"):
        assert np.allclose(getattr(counts, name), getattr(total, name), rtol=1e-9)
    assert counts.start.sum() == len(people) and len(set(got.values())) > 1


def test_resample_restores_counts():
    """Bit for bit, also where subtracting and adding again would not."""
    rng = np.random.default_rng(0)
    S, T = 3, 5
    c = GB.Counts(np.full(S, 5.0), np.full((S, S), 4.0), np.full(S, 12.0), np.full((S, T), 1e9 / 3), np.full(S, 1e9 / 7), 15)
    X = rng.gamma(1.0, 1e-3, size=(3, T))
    for zz in (np.array([1, 1, 1]), np.array([0]), np.array([0, 2])):
        before = c.copy()
        k = len(zz)
        for _ in range(10):
            z_new, _ = GB.resample_sequence(zz, X[:k], X[:k].sum(axis=1), c, GB.Priors(S, T), rng)
            assert z_new.shape == (k,)
        for name in ("start", "trans", "tots", "topics", "totals"):
            assert np.array_equal(getattr(c, name), getattr(before, name))


def test_lgamma_expression(spark):
    from math import lgamma

    from jobtrails.functions.special import lgamma as column

    values = [1e-9, 0.3, 1.0, 1.5, 7.9, 15.999, 16.0, 170.0, 1e6, 1e15]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    for r in d.select("x", column(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(lgamma(r["x"]), rel=1e-12, abs=1e-12)


def test_scores_run_without_python(spark):
    import __spark_entry__ as E
    for name in ("state_topic_loglik", "state_seq_loglik"):
        plan = E.queries()[name](spark, SF01)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Pandas", "Arrow", "Python"))


def test_lda_empty_and_unknown_documents(spark):
    train = spark.createDataFrame([(1, "alpha beta gamma alpha"), (2, "beta gamma delta beta"),
                                   (3, "gamma delta alpha delta"), (4, None)], "job_id long, text string")
    model = TOP.fit_lda(train, "job_id", "text", k=2, max_iter=5, seed=1)
    # every token of every document is in the weights, next to the prior
    mass = {r["word"]: r["w0"] + r["w1"] for r in model.weights.collect()}
    assert mass == pytest.approx({w: 3 + 2 * 0.5 for w in ("alpha", "beta", "gamma", "delta")})
    new = spark.createDataFrame([(7, ""), (8, "zzz yyy"), (9, None), (10, "alpha alpha zzz")],
                                "job_id long, text string")
    out = {r["job_id"]: r["topics"] for r in TOP.lda_doc_topics(model, new, "job_id", "text", normalized=False).collect()}
    assert out[7] == out[8] == out[9] == pytest.approx([0.5, 0.5])
    assert sum(out[10]) == pytest.approx(2 + 1)
    norm = TOP.lda_doc_topics(model, train, "job_id", "text").collect()
    assert len(norm) == 4 and all(sum(r["topics"]) == pytest.approx(1.0) for r in norm)


def test_lda_separates_topics_whatever_the_blocks(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    pools = [[f"{c}{x}" for x in "abcdefgh"] for c in ("sun", "sea")]
    docs = [(i, " ".join(rng.choice(pools[i % 2], 30))) for i in range(60)]
    df = spark.createDataFrame(docs, "job_id long, text string")
    model = TOP.fit_lda(df, "job_id", "text", k=2, max_iter=15, seed=3)
    TOP.save_model(model, str(tmp_path / "m"))
    one = {r["job_id"]: r["topics"] for r in
           TOP.lda_transform_heldout(spark, str(tmp_path / "m"), df, "job_id", "text").collect()}
    side = {i % 2: int(np.argmax(t)) for i, t in one.items()}
    assert side[0] != side[1] and all(int(np.argmax(t)) == side[i % 2] for i, t in one.items())
    monkeypatch.setattr(TOP, "BLOCK_ROWS", 60)
    two = {r["job_id"]: r["topics"] for r in TOP.lda_doc_topics(
        TOP.fit_lda(df, "job_id", "text", k=2, max_iter=15, seed=3), df, "job_id", "text").collect()}
    assert all(np.allclose(one[i], two[i], atol=1e-2) for i in one)


def test_gibbs_scores_on_fixture_views(spark):
    import __spark_entry__ as E
    got = E.queries()["state_seq_loglik"](spark, SF01)
    assert got.count() == 5000


def test_long_documents_in_parts(spark, monkeypatch):
    """A document cut into parts gets the weights of the whole one, and the
    model the same words; rows of a block stay few."""
    rng = np.random.default_rng(6)
    pools = [[f"{c}{i}" for i in range(60)] for c in ("sun", "sea")]
    docs = [(i, " ".join(rng.choice(pools[i % 2], 40))) for i in range(40)]
    docs += [(100 + i, " ".join(rng.choice(pools[i], 900))) for i in range(2)] + [(200, None)]
    df = spark.createDataFrame(docs, "job_id long, text string")

    def fit():
        model = TOP.fit_lda(df, "job_id", "text", k=2, max_iter=15, seed=3)
        found = TOP.lda_doc_topics(model, df, "job_id", "text", normalized=False)
        return model, {r["job_id"]: r["topics"] for r in found.collect()}

    _, whole = fit()
    monkeypatch.setattr(TOP, "PART_TERMS", 45)
    monkeypatch.setattr(TOP, "BLOCK_ROWS", 200)
    corpus = TOP._corpus(TOP.term_counts(df, "job_id", "text"), 0)
    assert corpus.parts.select("key").distinct().count() == 2 and corpus.tokens.where("parted").count() == 120
    assert corpus.parts.count() > 2
    model, parted = fit()
    assert {r["word"] for r in model.weights.collect()} == {w for pool in pools for w in pool}
    mass = model.weights.agg(F.sum(F.col("w0") + F.col("w1"))).first()[0]
    assert mass == pytest.approx(40 * 40 + 1800 + 120 * 2 * 0.5)
    assert set(parted) == set(whole) and parted[200] == whole[200]
    for i, topics in whole.items():
        if i != 200:
            assert np.argmax(topics) == np.argmax(parted[i]) and sum(topics) == pytest.approx(sum(parted[i]))
            assert np.allclose(topics, parted[i], rtol=0.05, atol=0.5)


def test_lda_blocks_are_packed_once(spark, monkeypatch):
    """Each block is one row, which holds every count of its documents; null
    keys keep the precision of the others; large corpora have larger blocks."""
    df = spark.createDataFrame([(2 ** 53 + 1, "sun sun sea"), (None, "sun lake"), (7, "sea"), (7, "sea hill"), (8, None)],
                               "job_id long, text string")
    counts = TOP.term_counts(df, "job_id", "text")
    monkeypatch.setattr(TOP, "BLOCK_ROWS", 3)
    corpus = TOP._corpus(counts, 0)
    rows = corpus.blocks.collect()
    assert len(rows) == len({r["block"] for r in rows}) <= 2 == TOP._n_blocks(counts.count())
    found = set()
    for r in rows:
        ids, at, n = (np.frombuffer(r[c], t) for c, t in (("ids", np.int64), ("at", np.int32), ("n", np.int64)))
        keys = [k for k, m in zip(r["keys"], np.frombuffer(r["size"], np.int32), strict=True) for _ in range(m)]
        found |= set(zip(keys, ids[at].tolist(), n.tolist(), strict=True))
    assert found == {(r["key"], r["id"], r["n"]) for r in TOP._hashed(counts, 0).collect()} and len(found) == 6
    assert {(r["block"], r["id"]) for r in corpus.terms.collect()} == {(r["block"], r["id"]) for r in corpus.tokens.collect()}
    model = TOP.fit_lda(df, "job_id", "text", k=2, max_iter=2, seed=3)
    assert model.weights.agg(F.sum(F.col("w0") + F.col("w1"))).first()[0] == pytest.approx(8 + 4 * 2 * 0.5)
    topics = {r["job_id"]: r["topics"] for r in TOP.lda_doc_topics(model, df, "job_id", "text", normalized=False).collect()}
    assert sum(topics[2 ** 53 + 1]) == pytest.approx(4) and sum(topics[7]) == pytest.approx(4) and topics[8] == [0.5, 0.5]
    monkeypatch.setattr(TOP, "BLOCK_ROWS", 100)
    assert [TOP._n_blocks(x) for x in (0, 100, 101, 9600, 9601, 38401)] == [1, 1, 2, 96, 96, 97]

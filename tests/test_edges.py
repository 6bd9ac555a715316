"""Edge rows for the scalar, sequence, join and statistics operators, each
checked against a direct (brute-force) reading of the rule."""

import datetime as dt
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobtrails.functions import dates as DT
from jobtrails.functions import location as LOC
from jobtrails.functions import text as TX
from jobtrails.operators import joins as JN
from jobtrails.operators import sequences as SQ
from jobtrails.operators import stats as ST
from jobtrails.operators import transitions as TR

D = dt.date


# ---------------------------------------------------------------- B1, B3
def test_clean_name_edges(spark):
    rows = [(1, None), (2, "Café Société"), (3, "!!!"), (4, "\tAcme, Inc.\t"), (5, "a  b")]
    df = spark.createDataFrame(rows, "k int, s string")
    got = dict(df.select("k", TX.clean_name(F.col("s")).alias("c")).collect())
    assert got == {1: "", 2: "caf socit", 3: "", 4: "acme inc", 5: "a  b"}
    nul = df.select("k", TX.clean_name(F.col("s"), None).alias("c")).where("k = 1").first()["c"]
    assert nul is None


def test_make_month_date_edges(spark):
    rows = [(1, "1999", None), (2, "1999", "0"), (3, "1999", "13"), (4, None, "5"),
            (5, "0", "5"), (6, "99", "5"), (7, "100", "5"), (8, "2001", "12")]
    df = spark.createDataFrame(rows, "k int, y string, m string")
    got = dict(df.select("k", DT.make_month_date(F.col("y"), F.col("m")).alias("d")).collect())
    assert got == {1: D(1999, 1, 1), 2: D(1999, 1, 1), 3: None, 4: None, 5: D(1900, 5, 1),
                   6: D(1999, 5, 1), 7: D(100, 5, 1), 8: D(2001, 12, 1)}


# ---------------------------------------------------------------- C1
def _fill_reference(stints):
    """Direct reading of the stint repair rule on one history."""
    s = [x for x in stints if x[1] is not None or x[2] is not None]
    s = sorted(s, key=lambda x: (x[1] or x[2], x[0]))
    if not s:
        return []
    s = [list(x) for x in s]
    if s[0][1] is None:
        s[0][1] = s[0][2]
    if s[-1][2] is None:
        s[-1][2] = s[-1][1]
    dates = sorted([x[1] for x in s if x[1]] + [x[2] for x in s if x[2]])
    out = []
    for pos, a, b in s:
        if b is None:
            later = [d for d in dates if d > a]
            b = later[0] if later else a
        elif a is None:
            earlier = [d for d in dates if d < b]
            a = earlier[-1] if earlier else b
        out.append((pos, a, b))
    return out


def test_stint_fill_edges(spark):
    histories = {
        1: [(1, None, None)],                                       # no dates
        2: [(1, None, D(2000, 1, 1))],                              # one stint, end only
        3: [(1, D(2000, 1, 1), None)],                              # one stint, start only
        4: [(1, None, D(2001, 1, 1)), (2, D(2002, 1, 1), D(2003, 1, 1))],   # first lacks start
        5: [(1, D(2000, 1, 1), D(2001, 1, 1)), (2, D(2002, 1, 1), None)],   # last lacks end
        6: [(1, D(2000, 1, 1), D(2001, 1, 1)), (2, D(2001, 6, 1), None),
            (3, None, D(2004, 1, 1)), (4, D(2005, 1, 1), D(2006, 1, 1))],   # middle lacks either
        7: [(1, D(2000, 1, 1), D(2003, 1, 1)), (2, D(2000, 1, 1), None),
            (3, D(2000, 1, 1), D(2001, 1, 1))],                     # equal starts: stable order
        8: [(1, D(2009, 1, 1), D(2010, 1, 1)), (2, D(2011, 1, 1), None),
            (3, None, D(2000, 1, 1)), (4, D(2012, 1, 1), D(2013, 1, 1))],   # nothing to borrow
    }
    rng = random.Random(1)
    for h in range(9, 40):   # random histories with holes
        n = rng.randint(1, 7)
        stints = []
        for p in range(1, n + 1):
            a = D(rng.randint(1990, 2010), rng.randint(1, 12), 1)
            b = D(rng.randint(1990, 2012), rng.randint(1, 12), 1)
            stints.append((p, a if rng.random() > 0.3 else None, b if rng.random() > 0.3 else None))
        histories[h] = stints
    rows = [(h, p, a, b) for h, st in histories.items() for p, a, b in st]
    df = spark.createDataFrame(rows, "person_id int, pos int, start_dt date, end_dt date")
    got = {}
    for r in SQ.stint_fill(df).collect():
        got.setdefault(r["person_id"], []).append((r["seq_pos"], r["pos"], r["start_dt"], r["end_dt"]))
    for h, st in histories.items():
        want = _fill_reference(st)
        have = [x[1:] for x in sorted(got.get(h, []))]
        assert have == want, (h, have, want)


# ---------------------------------------------------------------- C6
def test_title_sequences_edges(spark):
    rows = [
        (1, 1, 2000, None), (1, 2, 2001, "Engineer"), (1, 3, None, None), (1, 4, 2003, "Manager!"),
        (2, 1, 2000, "123"), (2, 2, 2001, "Clerk"),          # blank after cleaning -> dropped
        (3, 1, 2000, "Solo"),                                 # one job only
        (4, 1, 2002, "B"), (4, 2, 2001, "A"), (4, 3, None, None),  # last missing, year carries
    ]
    df = spark.createDataFrame(rows, "person_id int, pos int, start_year int, title string")
    got = {}
    for r in SQ.title_sequences(df).collect():
        got.setdefault(r["person_id"], []).append((r["seq_pos"], r["title"], r["start_year"]))
    assert sorted(got[1]) == [(1, "engineer", 2001), (2, "engineer", 2001), (3, "manager", 2003)]
    assert 2 not in got and 3 not in got
    # person 4: job 3 carries "a" and 2001 from job 2; stable sort by year
    assert sorted(got[4]) == [(1, "a", 2001), (2, "a", 2001), (3, "b", 2002)]


# ---------------------------------------------------------------- C9
def test_mass_cutoff_edges(spark):
    rows = [("t", "a", 0.3), ("t", "b", 0.2), ("t", "c", 0.2), ("t", "d", 0.3),
            ("u", "x", 0.5), ("u", "y", 0.5), ("v", "p", 0.1)]
    df = spark.createDataFrame(rows, "g string, w string, v double")
    got = {}
    for r in SQ.mass_cutoff(df, "g", "w", "v", 0.5).collect():
        got.setdefault(r["g"], []).append((r["rank"], r["w"]))
    assert sorted(got["t"]) == [(1, "d"), (2, "a")]            # tie broken by word desc
    assert sorted(got["u"]) == [(1, "y"), (2, "x")]            # threshold hit exactly: keep going
    assert sorted(got["v"]) == [(1, "p")]                      # threshold above total


# ---------------------------------------------------------------- D3
def _overlap(s1, e1, s2, e2):
    if s1 is None:
        if e1 is None:
            return False
        s1 = e1
    if s2 is None:
        if e2 is None:
            return False
        s2 = e2
    if s1 <= s2:
        return e1 is not None and s2 <= e1
    return e2 is not None and s1 < e2


def test_coworker_links_brute_force(spark):
    rng = random.Random(7)
    rows = [(1, 1, "c", 2000, 2002), (2, 1, "c", 2002, 2004),   # touching: s2 == e1 links
            (3, 1, "c", 2004, 2006), (3, 2, "c", 2003, 2004),   # touching the other way: no link
            (4, 1, "c", None, 2005), (5, 1, "c", 2005, None),  # null start / null end
            (6, 1, "c", None, None), (1, 2, "c", 2001, 2001)]   # both null; same person twice
    for p in range(7, 30):
        for k in range(1, rng.randint(1, 4)):
            a = rng.choice([None, rng.randint(1995, 2005)])
            b = rng.choice([None, rng.randint(1995, 2008)])
            rows.append((p, k, rng.choice("cde"), a, b))
    df = spark.createDataFrame(rows, "person_id int, pos int, company string, start_year int, end_year int")
    got = sorted(tuple(r) for r in JN.coworker_links(df).collect())
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    want = []
    for i in range(len(order)):
        for j in range(i + 1, len(order)):
            a, b = order[i], order[j]
            if a[2] == b[2] and _overlap(a[3], a[4], b[3], b[4]):
                want.append((a[0], b[0], a[2]))
    assert got == sorted(want)
    # the totals, counted without the pairs
    by_company, by_person = Counter(w[2] for w in want), Counter(p for w in want for p in w[:2])
    assert dict(map(tuple, JN.coworker_link_counts(df).collect())) == by_company
    assert dict(map(tuple, JN.coworker_person_counts(df).collect())) == by_person


def test_shared_employer_counts_brute_force(spark):
    rng = random.Random(11)
    rows = [(1, "x", D(2000, 1, 1), D(2000, 1, 1)), (2, "x", D(2000, 1, 1), D(2000, 1, 1)),  # one day, twice
            (3, "x", D(1999, 1, 1), D(2001, 1, 1)), (3, "x", D(2001, 1, 1), D(2002, 1, 1)),  # touching
            (4, "x", None, D(2001, 1, 1)), (5, None, D(1999, 1, 1), D(2001, 1, 1))]
    for p in range(10, 40):
        for _ in range(rng.randint(1, 5)):
            a = D(rng.randint(1995, 2003), rng.randint(1, 12), 1)
            rows.append((p, rng.choice("xyz"), a, D(a.year + rng.randint(0, 3), 12, 1) if rng.random() < .8 else a))
    df = spark.createDataFrame(rows, "person_id int, company string, start_dt date, end_dt date")
    got = {r["company"]: (r["n_people"], r["n_intervals"], r["n_overlaps"])
           for r in JN.shared_employer_counts(df).collect()}
    merged = {}
    for p, c, s, e in sorted((r for r in rows if all(x is not None for x in r)), key=lambda r: (r[0], r[1], r[2], r[3])):
        runs = merged.setdefault((p, c), [])
        if runs and runs[-1][1] > s:
            runs[-1] = (runs[-1][0], max(runs[-1][1], e))
        else:
            runs.append((s, e))
    want = {}
    for c in "xyz":
        own = [(p, s, e) for (p, k), runs in merged.items() if k == c for s, e in runs]
        n = sum(b[1] < a[2] and a[1] < b[2] for i, a in enumerate(own) for b in own[i + 1:])
        want[c] = (len({p for p, _, _ in own}), len(own), n)
    assert got == want


def test_fingerprint_tells_nulls_apart(spark):
    rows = [(1, None, "x"), (2, "x", None), (3, "x", None)]
    df = spark.createDataFrame(rows, "person_id int, a string, b string")
    fp = {r["person_id"]: tuple(r)[1:] for r in
          JN.history_fingerprint(df, "person_id", [F.col("a"), F.col("b")]).collect()}
    assert fp[1] != fp[2] == fp[3]


def test_hash_split_is_a_share(spark):
    from jobtrails.sources.splits import split_by_hash
    got = split_by_hash(spark.range(4000).union(spark.sql("select cast(null as bigint)")), "id", 80)
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert sum(n.values()) == 4001 and 3050 < n["train"] < 3350
    assert got.where("id is null").first()["split"] == "test"


def test_shared_employers_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for p in range(1, 25):
        for k in range(rng.randint(1, 4)):
            a = D(rng.randint(1995, 2005), rng.randint(1, 12), 1)
            b = D(a.year + rng.randint(0, 3), rng.randint(1, 12), 1)
            rows.append((p, rng.choice("xyz"), a, b))
    df = spark.createDataFrame(rows, "person_id int, company string, start_dt date, end_dt date")
    got = sorted(tuple(r) for r in JN.shared_employers(df).collect())
    want = set()
    for p1, c1, s1, e1 in rows:
        for p2, c2, s2, e2 in rows:
            if p1 < p2 and c1 == c2 and s2 < e1 and s1 < e2:
                want.add((p1, p2, c1))
    assert got == sorted(want)


def test_shared_employers_exclude_identical_company_sets(spark):
    rows = [(1, "x", D(2000, 1, 1), D(2002, 1, 1)), (2, "x", D(2001, 1, 1), D(2003, 1, 1)),   # same set {x}
            (3, "x", D(2001, 6, 1), D(2004, 1, 1)), (3, "y", D(1990, 1, 1), D(1991, 1, 1))]  # set {x, y}
    df = spark.createDataFrame(rows, "person_id int, company string, start_dt date, end_dt date")
    all_pairs = sorted(tuple(r) for r in JN.shared_employers(df).collect())
    kept = sorted(tuple(r) for r in JN.shared_employers(df, exclude_dups=True).collect())
    assert all_pairs == [(1, 2, "x"), (1, 3, "x"), (2, 3, "x")]
    assert kept == [(1, 3, "x"), (2, 3, "x")]


# ---------------------------------------------------------------- D1
def test_match_by_fingerprint_edges(spark):
    t = [(1, 1, "j1", "a"), (1, 2, "j2", "b"),      # owner of {a, b}
         (2, 1, "j3", "b"), (2, 2, "j4", "a"),      # same stints, other order -> collision
         (3, 1, "j5", "q")]
    p = [(10, 1, "p1", "a"), (10, 2, "p2", "b"),    # hit
         (11, 1, "p3", "b"), (11, 2, "p4", "a"),    # same key again -> miss (matched once)
         (12, 1, "p5", "zzz")]                      # no match
    tdf = spark.createDataFrame(t, "person_id int, pos int, job_id string, s string")
    pdf = spark.createDataFrame(p, "person_id int, pos int, job_id string, s string")
    jobs, counts = JN.match_by_fingerprint(tdf, pdf, "person_id", "pos", [F.col("s")], [F.col("s")])
    assert sorted(tuple(r) for r in jobs.collect()) == [(10, 1, 1, "j1"), (10, 2, 1, "j2")]
    assert tuple(counts.first()) == (1, 2, 1)


# ---------------------------------------------------------------- D8
def test_standardize_location_edges(spark):
    rows = [(1, "raleigh north carolina"), (2, "boston ma usa"), (3, "new york ny"),
            (4, "washington"), (5, "paris"), (6, ""), (7, "charleston west virginia")]
    df = spark.createDataFrame(rows, "k int, loc string")
    got = {r["k"]: (r["s"]["city"], r["s"]["state"], r["s"]["country"], r["s"]["status"])
           for r in df.select("k", LOC.standardize_location(F.col("loc")).alias("s")).collect()}
    assert got[1] == ("RALEIGH", "NC", "", "good")
    assert got[2] == ("BOSTON", "MA", "USA", "good")
    assert got[3] == ("NEW YORK", "NY", "", "good")          # last state token wins
    assert got[4] == ("", "WA", "", "good")                   # city named as a state
    assert got[5][3] == "bad" and got[6][3] == "empty"
    assert got[7] == ("CHARLESTON", "WV", "", "good")


# ---------------------------------------------------------------- E2, E14, E18
def test_next_title_top3_successor_counts(spark):
    seqs = {1: ["a"], 2: ["b", "x"], 3: ["c", "x", "c", "y"], 4: ["d", "x", "d", "y", "d", "z"],
            5: ["e", "v", "e", "w", "e", "x", "e", "y", "e", "z"]}
    rows = [(p, i + 1, t) for p, ts in seqs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "person_id int, pos int, title string")
    got = {}
    for r in TR.next_title_top3(df).collect():
        got.setdefault(r["title"], []).append(r["next_title"])
    assert got["a"] == [None]                                 # no successor: unseen
    assert len(got["b"]) == 1 and len(got["c"]) == 2
    assert len(got["d"]) == 3 and len(got["e"]) == 3          # 3 successors -> all 3


def test_mode_ties_lowest(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, "z")]
    df = spark.createDataFrame(rows, "doc int, state string")
    got = dict(ST.trace_mode_state(df, "doc", "state").collect())
    assert got == {1: "a", 2: "z"}


def test_vocab_encode_thresholds(spark):
    counted = [("nine",)] * 9 + [("ten",)] * 10 + [("eleven",)] * 11 + [("lonely",)] * 12
    seqs = [(1, 1, "ten"), (1, 2, "eleven"), (2, 1, "nine"), (2, 2, "ten")]
    c = spark.createDataFrame(counted, "title string")
    s = spark.createDataFrame(seqs, "person_id int, seq_pos int, title string")
    vocab, enc = ST.vocab_encode(c, s)
    v = {r["title"]: r["id"] for r in vocab.collect()}
    assert v == {"nine": 0, "ten": 2, "eleven": 1, "lonely": 0}
    held = spark.createDataFrame([("ten",), ("never",)], "title string")
    assert [r["title"] for r in JN.unseen_anti(held, vocab).collect()] == ["never"]


def test_unconcat_state_longest_suffix(spark):
    df = spark.createDataFrame([("old hickorytn",), ("boston ma",), ("fooillinois",)], "l string")
    got = [r[0] for r in df.select(LOC.unconcat_state(F.col("l"))).collect()]
    assert got[0].startswith("old hickory tn united states of america")
    assert got[1] is None
    assert got[2].startswith("foo illinois ")


def test_tokens_match_python_split(spark):
    rng = random.Random(5)
    words = ["The", "job", "and", "Über", "naïve", "x2", "don't", "a", "Ops", "of"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "!", ""]) for _ in range(12)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = dict(df.select("k", TX.tokens_nostop(F.col("t"))).collect())
    stops = set(TX.STOPWORDS)
    for i, t in enumerate(texts):
        assert got[i] == [w.lower() for w in t.split() if w.lower() not in stops]
    assert string.punctuation  # the ASCII set the cleaner removes


# ---------------------------------------------------------------- F1
def _replace_slow(tokens, scores):
    """Straight reading of the rule: one full pass per matched bigram."""
    found = []
    for a, b in zip(tokens, tokens[1:]):
        if (a, b) in scores and (a, b) not in found:
            found.append((a, b))
    out = list(tokens)
    for bg in sorted(found, key=lambda p: -scores[p]):     # stable: first occurrence on ties
        res, i = [], 0
        while i < len(out):
            if i + 1 < len(out) and (out[i], out[i + 1]) == bg:
                res.append("_".join(bg))
                i += 2
            else:
                res.append(out[i])
                i += 1
        out = res
    return out


def test_replace_bigrams_matches_slow_form(spark):
    """Runs of competing pairs, equal scores, repeated words, words that hold the delimiter."""
    import random

    from jobtrails.operators.text import bigram_replace
    rng = random.Random(3)
    for _ in range(4):
        alphabet = "abcd"[:rng.randint(1, 4)] + "ef"
        scores = {(x, y): float(rng.randint(1, 3)) for x in alphabet for y in alphabet if rng.random() < 0.6}
        docs = [[rng.choice([*alphabet, "x_y"] if rng.random() < 0.9 else ["a", "b"]) for _ in range(rng.randint(0, 14))]
                for _ in range(150)] + [["a"] * n for n in range(6)] + [None]
        df = spark.createDataFrame(list(enumerate(docs)), "id int, toks array<string>")
        got = {r["id"]: r["toks"] for r in bigram_replace(df, "id", "toks", scores).collect()}
        for i, toks in enumerate(docs):
            assert got[i] == _replace_slow(toks or [], scores), (toks, scores)
    # linear in the tokens
    long = spark.createDataFrame([(1, ["a", "b", "c"] * 100_000)], "id int, toks array<string>")
    out = bigram_replace(long, "id", "toks", {("a", "b"): 1.0, ("b", "c"): 2.0}).first()["toks"]
    assert out == ["a", "b_c"] * 100_000
    with pytest.raises(ValueError):
        bigram_replace(df, "id", "toks", {("a_b", "c"): 1.0})

def test_dense_join_neighbours_equal_window_form(spark):
    from tests.conftest import SF001
    from jobtrails.sources import tables as V
    ev = V.events_v(V.Tables(spark, SF001))
    a = sorted(tuple(r) for r in SQ.prev_next_links(ev).collect())
    b = sorted(tuple(r) for r in SQ.prev_next_links(ev, dense=True).collect())
    assert a == b and len(a) == ev.count()
    c1 = sorted(tuple(r) for r in TR.next_title_top3(ev).collect())
    c2 = sorted(tuple(r) for r in TR.next_title_top3(ev, dense_pos="pos").collect())
    assert c1 == c2


@pytest.mark.parametrize("hot", [0, 20, 10**6])
def test_stint_fill_skew_safe_equals_window_form(spark, monkeypatch, hot):
    monkeypatch.setattr(SQ, "HOT_ROWS", hot)  # all, some or none in ranges
    from tests.conftest import SF001
    from jobtrails.sources import tables as V
    j = V.jobs_v(V.Tables(spark, SF001))
    a = sorted(tuple(r) for r in SQ.stint_fill(j).collect())
    b = sorted(tuple(r) for r in SQ.stint_fill(j.repartition(5), skew_safe=True).collect())
    assert a == b and len(a) > 0


def test_range_row_number_splits_a_hot_group(spark):
    rows = [(1, i) for i in range(3000)] + [(2, i) for i in range(50)] + [(3, 7)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = SQ.range_row_number(df, "g", ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted((r["g"], r["v"], r["rn"]) for r in got) == \
        sorted((g, v, v + 1 if g != 3 else 1) for g, v in rows)


@pytest.mark.parametrize("hot", [0, 20, 10**6])
def test_carry_sequences_skew_safe_equal_window_form(spark, monkeypatch, hot):
    monkeypatch.setattr(SQ, "HOT_ROWS", hot)  # all, some or none in ranges
    from tests.conftest import SF001
    from jobtrails.sources import tables as V
    t = V.Tables(spark, SF001)
    tv = V.titles_v(t)
    a = sorted(tuple(r) for r in SQ.title_sequences(tv).collect())
    b = sorted(tuple(r) for r in SQ.title_sequences(tv.repartition(5), skew_safe=True).collect())
    assert a == b and len(a) > 0
    dv = V.docs_v(t)
    c = sorted((r[0], r[1], tuple(r[2]), r[3]) for r in SQ.desc_sequences(dv).collect())
    d = sorted((r[0], r[1], tuple(r[2]), r[3]) for r in SQ.desc_sequences(dv, skew_safe=True).collect())
    assert c == d


def test_range_forward_fill_hot_group(spark):
    rows = [(1, i, (i if i % 7 == 0 else None)) for i in range(2000)] + [(2, 0, None), (2, 1, 5)]
    df = spark.createDataFrame(rows, "g int, p int, v int").repartition(6)
    got = {(r["g"], r["p"]): r["f"] for r in
           SQ.range_forward_fill(df, "g", ["p"], {"f": F.col("v")}).collect()}
    for g, p, _ in rows:
        prev = [v for gg, pp, v in rows if gg == g and pp <= p and v is not None]
        assert got[(g, p)] == (prev[-1] if prev else None)


@pytest.mark.parametrize("hot", [0, 20, 10**6])
def test_transition_counts_skew_safe_equals_window_form(spark, monkeypatch, hot):
    monkeypatch.setattr(SQ, "HOT_ROWS", hot)  # all, some or none in ranges
    from tests.conftest import SF001
    from jobtrails.sources import tables as V
    tv = V.titles_v(V.Tables(spark, SF001))
    from collections import Counter
    a = Counter(tuple(r) for r in TR.transition_counts(tv).collect())
    b = Counter(tuple(r) for r in TR.transition_counts(tv.repartition(4), skew_safe=True).collect())
    assert a == b and len(a) > 0


# ---------------------------------------------------------------- A2-A4
def test_malformed_records_go_to_their_own_table(spark, tmp_path):
    from jobtrails.sources import resume_xml as RX
    (tmp_path / "r.xml").write_text(
        "<resumes><resume><ResumeID>1</ResumeID><ResumeTitle>ok</ResumeTitle></resume>\n"
        "<resume><ResumeID>3</ResumeID></resume>\n"
        "<resume><ResumeID>2</ResumeID><ResumeTitle>broken</WrongTag></resume></resumes>")
    raw = RX.read_resumes(spark, str(tmp_path / "r.xml"))
    assert sorted(r["resume_id"] for r in RX.etl_resumes(raw).collect()) == [1, 3]
    assert RX.etl_resumes(raw).count() == 2
    bad = RX.corrupt_records(raw).collect()
    assert len(bad) == 1 and "broken" in bad[0]["record"]


def test_malformed_record_in_the_middle_costs_only_itself(spark, tmp_path):
    from jobtrails.sources import resume_xml as RX
    (tmp_path / "r.xml").write_text("<resumes>" + "".join(
        f"<resume><ResumeID>{i}</Resume{'ID' * (i % 4 != 1)}></resume>\n" for i in range(40)) + "</resumes>")
    raw = RX.read_resumes(spark, str(tmp_path / "r.xml"))
    assert sorted(r["resume_id"] for r in RX.etl_resumes(raw).collect()) == [i for i in range(40) if i % 4 != 1]
    assert len(RX.corrupt_records(raw).collect()) == 10


def test_xml_records_are_cut_one_by_one():
    from jobtrails.sources import xml_tags as XT

    def cut(chunk):
        return [(text, tree is not None) for text, tree in XT.records(chunk, "resume")]

    assert cut("<resumes>\n<resume a='1'><A>x</A>") == [("<resume a='1'><A>x</A></resume>", True)]
    assert cut("\n</resumes>") == [] and cut("") == []
    assert cut("<resume><A>1</B>") == [("<resume><A>1</B></resume>", False)]
    # one that was never closed, then a sound one
    assert cut("<resume><A>1</A>\n<resume><B/>") == [("<resume><A>1</A>\n", False), ("<resume><B/></resume>", True)]
    assert cut("<resume /><resume>") == [("<resume />", True), ("<resume></resume>", True)]


def test_xml_attribute_histograms(spark, tmp_path):
    """Every tag of the data, also those that no schema names, in plain and
    gzip files; malformed records leave the others alone."""
    import gzip
    import xml.etree.ElementTree as ET
    from collections import Counter

    from jobtrails.operators import stats
    from jobtrails.sources import xml_tags as XT

    job = "<experiencerecord><Company>c{0}</Company>{1}</experiencerecord>"
    texts = ["<resumes>" + "".join(
        f"<resume id='{i}'><ResumeID>{i}</ResumeID>" + (f"<Salary>{i % 2}</Salary>" if i % 3 else "<Salary/>")
        + (f"<Odd><Thing><Deep>{i % 3}</Deep></Thing><Other>&amp; é</Other></Odd>" if i % 7 == part else "")
        + ("<experience>" + "".join(job.format(k, "<Title>t</Title>" * (k % 2)) for k in range(i % 4 + 1)) + "</experience>"
           if i % 5 else "") + "</resume>" for i in range(24)) + "</resumes>" for part in (0, 1)]
    broken = "<resume><ResumeID>7</Wrong></resume><resume><Never>closed</Never>\n"
    (tmp_path / "a.xml").write_text(texts[0].replace("<resume id='5'>", broken + "<resume id='5'>"))
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write(texts[1])
    counts = XT.tag_counts(spark, str(tmp_path))
    got = {(r["element"], r["attr"], r["value"]): r["n"]
           for r in stats.element_histograms(XT.attr_rows(counts), topn=10).collect()}
    assert sorted(r["record"] for r in XT.bad_records(spark, str(tmp_path)).collect()) == [
        "<resume><Never>closed</Never>\n", "<resume><ResumeID>7</Wrong></resume>"]

    elements, paths = {}, set()
    for text in texts:
        todo = [(e, "resume") for e in ET.fromstring(text)]
        while todo:
            e, path = todo.pop()
            elements.setdefault(path, []).append(e)
            for x in e:
                paths.add((f"{path}/{x.tag}", path))
                todo.append((x, f"{path}/{x.tag}"))
    want = Counter()
    for element, found in elements.items():
        hists = {}
        for e in found:
            for x in e:
                name, value = (f"{x.tag}.{x[0].tag}_count", str(len(x))) if len(x) else (x.tag, x.text)
                hists.setdefault(name, Counter())[value] += 1
        for name, h in hists.items():
            top = sorted(h.items(), key=lambda y: (-y[1], y[0] is not None, y[0] or ""))[:9]
            want.update({(element, name, v): n for v, n in top})
            rest, none = sum(h.values()) - sum(n for _, n in top), len(found) - sum(h.values())
            want.update({(element, name, v): n for v, n in (("* other *", rest), ("* missing *", none)) if n > 0})
    assert got == dict(want) and ("resume/Odd", "Thing.Deep_count", "1") in got
    assert {tuple(r) for r in XT.schema_paths(counts).collect()} == paths

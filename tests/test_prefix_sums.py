"""Weighted prefix sums over ranges and what is built on them."""

import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from jobtrails.operators import joins as JN
from jobtrails.operators import sequences as SQ
from jobtrails.operators import stats as ST
from tests.conftest import SF01


def windows(df) -> list[str]:
    """Partition columns of every window of the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Window \[(?:[^\[\]]|\[[^\]]*\])*\], \[([^\]]*)\]", plan)


@pytest.mark.parametrize("parts", [1, 13])
def test_range_running(spark, parts):
    rng = random.Random(parts)
    # one group holds most rows; a null group; ties in the order are broken by id
    rows = [(i, rng.choice(["hot"] * 8 + ["b", None]), rng.randint(0, 9), rng.choice([None, 0, 1, 5])) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame(rows, "id int, g string, o int, v int").repartition(parts)
        got = SQ.range_running(d, "g", [F.col("o").desc(), "id"], {"s": F.col("v"), "c": F.lit(1)}, rank="r").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total = {}, {}
    for i, g, _, v in sorted(rows, key=lambda x: (-x[2], x[0])):
        s, c = total.get(g, (0, 0))
        want[i] = (s, c, c + 1)
        total[g] = (s + (v or 0), c + 1)
    assert {r["id"]: (r["s"], r["c"], r["r"]) for r in got} == want
    assert {(r["g"], r["s_total"], r["c_total"]) for r in got} == {(g, *t) for g, t in total.items()}


def test_range_running_of_empty_table(spark):
    d = spark.createDataFrame([], "g string, o int, v int")
    out = SQ.range_running(d, "g", ["o"], {"s": F.col("v")})
    assert out.columns == ["g", "o", "v", "s", "s_total"] and out.collect() == []


def test_mass_cutoff_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(t, f"w{i}", rng.randint(1, 6)) for t in range(4) for i in range(200)]
    got = SQ.mass_cutoff(spark.createDataFrame(rows, "topic int, word string, n int").repartition(7), "topic", "word", "n")
    assert not any(re.match(r"topic#\d+", w) for w in windows(got))
    want = set()
    for t in range(4):
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1]), reverse=True)
        before = 0
        for rank, r in enumerate(mine, 1):
            if 2 * before <= sum(x[2] for x in mine):
                want.add((*r, rank))
            before += r[2]
    assert {(r["topic"], r["word"], r["n"], r["rank"]) for r in got.collect()} == want


def test_no_window_over_a_company_year_or_a_state(spark):
    stints = spark.createDataFrame([(i, 1, "c", 2000 + i % 3, 2001 + i % 4) for i in range(50)],
                                   "person_id int, pos int, company string, start_year int, end_year int")
    for df in (JN.coworker_link_counts(stints), JN.coworker_person_counts(stints)):
        assert not any("_y#" in w and "_pid#" not in w for w in windows(df))
    means = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 0.0)], "s1 string, s2 string, mean double")
    out = ST.state_mobility(means)
    assert not any(re.match(r"s1#", w) for w in windows(out))
    assert {(r["kind"], r["state"], r["n_states"]) for r in out.collect()} == {
        (k, s, n) for k in ("most", "least") for s, n in (("a", 1), ("b", None))}
    share = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 6.0), (None, 1, 1.0)], "state string, topic int, mass double")
    out = SQ.normalise(share, "state", "mass", out="share")
    assert not windows(out)
    assert {(r["state"], r["topic"], r["mass"], r["share"]) for r in out.collect()} == {
        ("s", 1, 2.0, 0.25), ("s", 2, 6.0, 0.75), (None, 1, 1.0, 1.0)}


@pytest.mark.parametrize("values", [[], [None], [3], [1, 2], [5, 5, 5, 1], list(range(1001)), [None, 7, -2, 7, 9]])
def test_exact_median(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    got = ST.count_stats(d, "v").first()
    known = [v for v in values if v is not None]
    assert got["median"] == (median(known) if known else None)
    assert got["max"] == (max(known) if known else None)
    plan = ST.count_stats(d, "v")._jdf.queryExecution().toString()
    assert "median(" not in plan and "percentile" not in plan

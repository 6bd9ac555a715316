"""Jobs on pairs of people, all of them."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

from jobtrails.plans.catalog import QUERIES

D = datetime.date


def _tables(spark, folder, stints):
    """Driver tables whose jobs are ``stints`` (person, supplier, first and last day); an order for each."""
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    # keys that leave both dates in (see jobs_v)
    keys = [k for k in range(1, 40 * len(stints)) if (k + 1) % 11 and (k + 1) % 7][:len(stints)]
    write([(k, 1, 1, c, e) for k, (_, c, _, e) in zip(keys, stints, strict=True)],
          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate date", "lineitem")
    write([(k, p, s) for k, (p, _, s, _) in zip(keys, stints, strict=True)],
          "o_orderkey bigint, o_custkey bigint, o_orderdate date", "orders")
    write([(1, "clerk", "ROOM")], "p_partkey bigint, p_name string, p_type string", "part")
    write([(c, f"c{c}") for c in range(1, 4)], "s_suppkey bigint, s_name string", "supplier")


def test_shared_employers_makes_every_pair_of_people(spark, tmp_path):
    rng = random.Random(8)
    stints = []
    for p in range(1, 13):
        for _ in range(rng.randint(1, 4)):
            a = D(rng.randint(1995, 1999), rng.randint(1, 12), 1)
            stints.append((p, rng.randint(1, 3), a, D(a.year + rng.randint(0, 2), 12, 1)))
    _tables(spark, str(tmp_path), stints)
    links = {(a[0], b[0], a[1]) for a in stints for b in stints
             if a[0] != b[0] and a[1] == b[1] and b[2] < a[3] and a[2] < b[3]}
    partners = defaultdict(list)
    for p, q, _ in links:
        partners[p].append(q)
    got = {r["person_id"]: (r["n_partners"], r["n_links"]) for r in QUERIES["shared_employers"](spark, str(tmp_path)).collect()}
    assert got == {p: (len(set(q)), len(q)) for p, q in partners.items()}
    assert any(len(set(q)) < len(q) for q in partners.values())

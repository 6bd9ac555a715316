"""Appends to the trace store count whole or not at all."""

import pytest
from pyspark.sql import functions as F

from jobtrails.sources.sequences_io import TraceStore


def table(spark, iters, value):
    return spark.createDataFrame([(i, k, value) for i in iters for k in range(3)], "iter int, k int, v int")


def values(df):
    return sorted((r["iter"], r["k"], r["v"]) for r in df.collect())


def rows(iters, value):
    return [(i, k, value) for i in iters for k in range(3)]


class Torn(Exception):
    pass


class Breaks(dict):
    """Tables of which the last can't be written."""

    def items(self):
        for k, v in super().items():
            if k == "states":
                raise Torn
            yield k, v


def test_append_read_latest(spark, tmp_path):
    store = TraceStore(str(tmp_path / "t"))
    store.append({"tables": table(spark, [0, 1], 1), "states": table(spark, [0, 1], 2)})
    store.append({"tables": table(spark, [2], 3), "states": table(spark, [2], 4)})
    assert values(store.read(spark, "tables")) == rows([0, 1], 1) + rows([2], 3)
    last = store.latest(spark, ["tables", "states"])
    assert values(last["tables"]) == rows([2], 3) and values(last["states"]) == rows([2], 4)


def test_torn_append_is_never_read(spark, tmp_path):
    store = TraceStore(str(tmp_path / "t"))
    store.append({"tables": table(spark, [0], 1), "states": table(spark, [0], 1)})
    with pytest.raises(Torn):
        store.append(Breaks(tables=table(spark, [1], 9), states=table(spark, [1], 9)))
    assert values(store.read(spark, "tables")) == rows([0], 1)
    assert values(store.latest(spark, ["tables", "states"])["tables"]) == rows([0], 1)
    store.append({"tables": table(spark, [1], 5), "states": table(spark, [1], 5)})  # the retry
    assert values(store.read(spark, "tables")) == rows([0], 1) + rows([1], 5)
    assert values(store.latest(spark, ["tables", "states"])["states"]) == rows([1], 5)


def test_repeated_append_replaces(spark, tmp_path):
    store = TraceStore(str(tmp_path / "t"))
    for v in (1, 2):
        store.append({"tables": table(spark, [0, 1], v)})
    store.append({"tables": table(spark, [1], 7)})
    assert values(store.read(spark, "tables")) == rows([0], 2) + rows([1], 7)


def test_tables_of_one_commit_may_differ_in_iterations(spark, tmp_path):
    store = TraceStore(str(tmp_path / "t"))
    store.append({"a": table(spark, [0, 1, 2], 1), "b": table(spark, [0, 1], 1)})
    assert values(store.latest(spark, ["a", "b"])["a"]) == rows([1], 1)
    assert values(store.latest(spark, ["a"])["a"]) == rows([2], 1)


def test_erase_and_empty(spark, tmp_path):
    store = TraceStore(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        store.latest(spark, ["tables"])
    store.append({"tables": table(spark, [0, 1], 1)})
    store.append({"tables": table(spark, [0], 2)}, erase=True)
    assert values(store.read(spark, "tables")) == rows([0], 2)
    store.append({"tables": table(spark, [3], 3)})
    assert store.read(spark, "tables").agg(F.count_distinct("iter")).first()[0] == 2

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobtrails.llm import (decontam, gru_lm, host_quality, langid, packing, pfp_dedup, sharding, simhash, toxicity,
                           url_trie)
from jobtrails.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (5, 1, 0), (7, 0, 1), (None, 0, 1), (8, None, None)],
                                 "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "kalo mitu"), (2, None), (None, "x" * 99), (3, "lo" * 300)],
                                 "item_id bigint, text string")


def operators(labels, benchmark):
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "decontam": lambda d: decontam.decontaminate(d, benchmark),
        "quality": host_quality.quality_filter,
        "packing": lambda d: packing.pack(d, tokenizer_path()),
        "simhash": simhash.near_duplicates,
        "langid": langid.identify,
        "sharding": sharding.shard_by_bytes,
        "lm": gru_lm.score_documents,
        "repeats": pfp_dedup.remove_repeats,
    }


NAMES = ["toxicity", "decontam", "quality", "packing", "simhash", "langid", "sharding", "lm", "repeats"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_get_a_result(make, odd_rows, labels, benchmark, name):
    got = operators(labels, benchmark)[name](make(rows=odd_rows)).collect()
    if name == "packing":
        got = [r for r in got if r["piece"] == 0]
    assert len(got) == len(odd_rows)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(make, labels, benchmark, name):
    assert operators(labels, benchmark)[name](make(rows=[])).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns(spark, make, odd_rows, tmp_path, benchmark, name, stage):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make(rows=odd_rows)
    out = stage(spark, docs, str(tmp_path))
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert all(r["score"] in ("s", None) and r["k"] in ("k", None) for r in rows)
    empty = stage(spark, make(rows=[]), str(tmp_path))
    assert empty.columns == docs.columns and empty.collect() == []


def test_near_copy_stage_keeps_one_of_each_group(spark, make, odd_rows):
    docs = make(rows=odd_rows)
    kept = simhash.drop_near_duplicates(docs).collect()
    groups = simhash.near_duplicates(docs)
    assert len(kept) == groups.select("component_id").distinct().count()
    base = odd_rows[5][1]
    assert [r["doc_id"] for r in kept if (r["text"] or "").startswith(base)] == [5]


def test_quality_values_of_odd_rows(make, odd_rows):
    got = {r["doc_id"]: r for r in host_quality.quality_filter(make(rows=odd_rows)).collect() if r["doc_id"] is not None}
    assert (got[0]["n_words"], got[0]["base_failed"], got[0]["kept"]) == (0, True, False)
    assert got[8]["n_words"] == 60_000
    assert got[11]["n_words"] == 1                      # other white space doesn't split
    assert got[12]["n_dup_lines"] == 2
    assert got[9]["n_symbols"] == 6


def test_shard_sizes_of_null_text(make, odd_rows):
    got = {r["doc_id"]: r for r in sharding.shard_by_bytes(make(rows=odd_rows), 4).collect()}
    assert got[0]["size"] == 8 and got[0]["text_crc32"] == 0
    assert got[4]["size"] == 8 + len("ä é 漢字".encode())


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls(spark, limit):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("org/fr/a", "allow"), ("org/fr/", "block"),
             ("a.org/fr/", "allow"), ("tie.com/", "allow"), ("tie.com/", "block"), ("xnet", "block"), (None, "block"),
             ("x.net/", None)]
    urls = {None: (None, "allow"), "no scheme": (None, "allow"), "": (None, "allow"),
            "http://EXAMPLE.net/en/x": ("example.net/en/", "allow"), "http://example.net/en": ("net/", "block"),
            "http://x.net": (None, "allow"), "http://x.net?q=/": (None, "allow"), "http://x.net/": ("net/", "block"),
            "http://xnet/": (None, "allow"), "s://b.org/fr/abc": ("org/fr/a", "allow"),
            "s://b.org/fr/b": ("org/fr/", "block"), "s://q.a.org/fr/abc": ("a.org/fr/", "allow"),
            "s://b.org/FR/a": (None, "allow"), "x://tie.com/": ("tie.com/", "block"),
            "http://y.net/#a": ("net/", "block"), "http://h.net://z/": (None, "allow"), "a\nb://u.net/\n": ("net/", "block")}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id bigint, url string")
    got = url_trie.judge_urls(pages, rules, max_trie_bytes=limit).collect()
    assert len(got) == 2 * len(urls)
    want = list(urls.values())
    for r in got:
        assert (r["rule"], r["verdict"]) == want[r["page_id"]], r
    assert url_trie.judge_urls(pages.limit(0), rules, max_trie_bytes=limit).collect() == []
    assert {r["verdict"] for r in url_trie.judge_urls(pages, [], max_trie_bytes=limit).collect()} == {"allow"}


def test_no_labels_and_no_languages(spark, make, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(make(rows=odd_rows), none).collect()} == {0}
    blank = make(rows=odd_rows).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(blank).collect()} == {("und", 0.0)}

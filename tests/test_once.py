"""Steps that read their input once, however many branches need it."""

from __future__ import annotations

import glob
import random

from pyspark.sql import functions as F

from jobtrails.functions import text as TX
from jobtrails.operators import joins as JN
from jobtrails.operators import stats as ST
from jobtrails.operators import text as TXT
from jobtrails.session import stage_path
from jobtrails.sources import resume_xml as RX
from jobtrails.sources import xml_tags as XT


def _watched(df):
    """The rows, and an accumulator of how many were read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def _xml(spark, tmp_path):
    text = "".join(f"<resume><a>{i % 3}</a><b><c>x</c><c>y</c></b></resume>" for i in range(20))
    (tmp_path / "r.xml").write_text(f"<resumes>{text}</resumes>")
    return str(tmp_path)


def test_tags_are_counted_once_for_all_histograms(spark, tmp_path):
    out = ST.element_histograms(XT.attr_rows(XT.tag_counts(spark, _xml(spark, tmp_path))))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [
        ("resume", "a", "0", 7), ("resume", "a", "1", 7), ("resume", "a", "2", 6), ("resume", "b.c_count", "2", 20),
        ("resume/b", "c", "x", 20), ("resume/b", "c", "y", 20)]


def test_paths_need_no_values(spark, tmp_path):
    counts = XT.tag_counts(spark, _xml(spark, tmp_path), values=False)
    assert counts.where(F.col("attr").isNotNull()).isEmpty()
    assert sorted(tuple(r) for r in XT.schema_paths(counts).collect()) == [
        ("resume/a", "resume"), ("resume/b", "resume"), ("resume/b/c", "resume/b")]


def test_gzipped_shards_are_small_files(spark, monkeypatch):
    monkeypatch.setattr(RX, "GZIP_RECORDS", 5)
    rows = spark.range(0, 101, 1, 1).select(F.col("id").cast("string").alias("ResumeID"))
    _, odd = RX.write_shards(rows, stage_path(spark, "xml_small"))
    assert len(glob.glob(odd.removeprefix("file://") + "/part-*.gz")) == 10
    assert RX.read_resumes(spark, odd).select("ResumeID").distinct().count() == 50


def test_titles_are_counted_once_for_the_vocabulary(spark):
    titles = [("a", 12), ("b", 15), ("c", 3), ("d", 11)]
    rows = spark.createDataFrame([(t,) for t, n in titles for _ in range(n)], "title string")
    counted, seen = _watched(rows)
    seqs = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate("abcz")], "person_id int, seq_pos int, title string")
    vocab, enc = ST.vocab_encode(counted, seqs)
    assert {r["title"]: r["id"] for r in vocab.collect()} == {"b": 1, "a": 2, "c": 0, "d": 0}
    assert sorted((r["title"], r["id"]) for r in enc.collect()) == [("a", 2), ("b", 1), ("c", 0), ("z", 0)]
    assert seen.value == 41


def test_texts_are_cut_into_tokens_once_for_bigrams(spark):
    docs, seen = _watched(spark.createDataFrame([(i, "red fox sat, red fox ran") for i in range(9)], "id int, text string"))
    best = TXT.bigram_llr(docs, "id", "text", num=2)
    assert [(r["w1"], r["w2"], r["n"]) for r in best.collect()] == [("red", "fox", 18), ("fox", "ran", 9)]
    assert seen.value == 9


def test_pairs_of_some_people_read_the_stints_twice(spark):
    rows = [(p, c, f"20{10 + p % 3}-01-01", "2015-01-01") for p in range(12) for c in ("x", "y", f"own{p}")]
    rows += [(3, None, "2010-01-01", "2015-01-01"), (4, None, "2010-01-01", "2015-01-01")]
    stints = spark.createDataFrame(rows, "person_id int, company string, s string, e string") \
                  .select("person_id", "company", F.to_date("s").alias("start_dt"), F.to_date("e").alias("end_dt"))
    every = {tuple(r) for r in JN.shared_employers(stints).collect()}
    watched, seen = _watched(stints)
    some = JN.shared_employers(watched, people=spark.createDataFrame([(3,)], "person_id int"))
    assert {tuple(r) for r in some.collect()} == {x for x in every if 3 in x[:2]} != set()
    assert seen.value <= 2 * len(rows)  # for the companies, and for the pairs


def test_clean_title_keeps_letters_and_spaces(spark):
    odd = ["", " ", "Ab-c 1", "ÀB\tc  d", "😀x\n", "123", None, "İstanbul K"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    for r in df.select(TX.clean_title(F.col("t")).alias("a"), F.regexp_replace(F.lower("t"), "[^a-zA-Z ]", "").alias("b")).collect():
        assert r["a"] == r["b"]


def _joined(words, scores):
    """The reference: best bigram first, each left to right without overlap."""
    words = [w for w in words]
    pairs = list(zip(words, words[1:]))
    for p in sorted(set(pairs) & set(scores), key=lambda p: (-scores[p], pairs.index(p))):
        out, i = [], 0
        while i < len(words):
            if tuple(words[i:i + 2]) == p:
                out.append("_".join(p))
                i += 2
            else:
                out.append(words[i])
                i += 1
        words = out
    return words


def test_bigrams_join_as_one_after_the_other(spark):
    rng = random.Random(5)
    scores = {(a, b): float(rng.randrange(4)) for a in "abcd" for b in "abcd" if rng.random() < 0.6}
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(40))] for _ in range(200)] + [[], ["a"], ["a"] * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t array<string>")
    got = {r["id"]: r["t"] for r in TXT.bigram_replace(df, "id", "t", scores).collect()}
    assert got == {i: _joined(t, scores) for i, t in enumerate(texts)}


def test_tokens_of_odd_texts(spark):
    plain = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+"
    odd = ["", " ", "Ab-c 1_x", "À,B\tc  d²", "😀x\n!?", None, "İ K\u00a0ß\u2003...", "日本 語①"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    for r in df.select(TX.tokens_wordpunct(F.col("t")).alias("a"), F.regexp_extract_all(F.lower("t"), F.lit(plain), 0).alias("b")).collect():
        assert r["a"] == r["b"]

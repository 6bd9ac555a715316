"""Operators against plain Python on small corpora with planted cases."""

import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from jobtrails.llm import components, decontam, gru_lm, langid, packing, pfp_dedup, sharding, simhash, toxicity
from jobtrails.llm.queries import tokenizer_path
from scripts.check_oracles import digest
from tests.conftest import SF001, SF01
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(E.LLM_ORACLES))
def test_sql(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    rows, cur = [tuple(r) for r in df.collect()], duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns) and len(rows) == len(want)
    assert digest(rows, df.columns) == digest(want, names)


def test_every_operator_is_registered():
    found = {int(m[1]) for n in E.LLM_QUERIES if (m := re.match(r"op(\d+)_", n))}
    assert found == set(range(1, 14)) and "pipeline" in E.LLM_QUERIES


# ---------------------------------------------------------------- 1

def test_segments_are_maximal():
    def brute(s):
        """Repeatedly take the best segment of the most positive sum, then both sides."""
        best = (0.0, 0, 0)
        for i in range(len(s)):
            total = 0.0
            for j in range(i, len(s)):
                total += s[j]
                if total > best[0] + 1e-9:
                    best = (total, i, j + 1)
        if best[0] <= 0:
            return []
        _, a, b = best
        return [*brute(s[:a]), (a, b), *[(x + b, y + b) for x, y in brute(s[b:])]]

    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(-9, 9, rng.integers(0, 40)).astype(float) + rng.random() * 1e-3
        got = [(a, b) for a, b, _ in toxicity.segments(s)]
        sums = lambda x: [round(float(s[a:b].sum()), 6) for a, b in x]
        assert sorted(sums(got)) == sorted(sums(brute(list(s)))) if len(s) else got == []


def test_toxic_documents_are_found(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        w = words(rng, 60)
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(40)
            w[at:at + 8] = [rng.choice(["vile", "scorn", "hate"]) + rng.choice(["ful", "s", "ed", ""]) for _ in range(8)]
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_a_passage_scores_alike_wherever_it_stands(spark):
    rng, rows = random.Random(4), []
    bad = [f"{a}{b}" for a in ("vile", "scorn", "hate") for b in ("ful", "s", "ed")]
    for i in range(300):
        w = words(rng, 60)
        if i % 6 == 0:
            w[20:28] = rng.sample(bad, 8)
        rows.append((" ".join(w), int(i % 6 == 0)))
    model = toxicity.fit_scores(spark.createDataFrame(rows, "text string, toxic int"))
    clean = lambda n: rng.choices(" ".join(t for t, x in rows if not x).split(), k=n)
    passage, scattered = bad[:8], [w for _ in range(5) for x in bad[:8] for w in [x, *clean(80)]]
    texts = [clean(300) + passage + clean(300), scattered + passage, [*passage, *clean(300)] * 3]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in toxicity.score_segments(docs, model, ["doc_id"]).collect()}
    alone = [x for x in got[0]["seg_score"] if x > 10]
    assert len(alone) == 1
    for k, at in ((1, [len(scattered)]), (2, [0, 308, 616])):
        found = {a: (z - a, x) for a, z, x in zip(got[k]["seg_start"], got[k]["seg_end"], got[k]["seg_score"], strict=True)}
        assert [found.get(a) for a in at] == [(8, pytest.approx(alone[0]))] * len(at)


def test_segments_have_the_expected_number_of_their_law(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    truth, rows = toxicity._labelled(docs, labels, 5)
    model = toxicity.fit_scores(rows)
    # lambda: the expectation of exp(lambda s) over the words of clean texts is 1
    p = (model.n1 + toxicity.WORD_PRIOR * model.share) / (model.n1 + model.n0 + toxicity.WORD_PRIOR)
    s = np.log(p / (1 - p)) - math.log(model.share / (1 - model.share)) - toxicity.DRIFT
    assert (model.n0 / model.n0.sum()) @ np.exp(model.scale * s) == pytest.approx(1, abs=1e-6)
    got = toxicity.score_toxicity(docs, labels).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in truth.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    best, clean = {}, []
    for i, text in texts.items():
        w = toxicity.tokens(text.lower().encode())
        x = [z * model.scale for _, _, z in toxicity.segments(np.array([model.of(t) for t in w], float))]
        best[i] = sorted((z for z in x if z > math.log(max(len(w), 1) * toxicity.MIN_K)), reverse=True)
        if toxic.get(i) == 0 and w:
            clean.append((best[i] or [0])[0] - math.log(len(w)))
    k = max(math.log(toxicity.MIN_K), sum(clean) / len(clean) - 0.5772156649)
    for r in got:
        want = [r["n_tokens"] * math.exp(k - x) for x in best[r["doc_id"]]]
        assert sorted(r["seg_e"]) == pytest.approx(want, rel=1e-6)
        assert r["n_segments"] == sum(e <= toxicity.LEVEL for e in r["seg_e"])


# ---------------------------------------------------------------- 2

def test_leaks_with_edits_are_found(spark):
    rng = random.Random(9)
    items = [" ".join(words(rng, n)) for n in (20, 35, 60)]

    def edited(text, share):
        t = list(text)
        for _ in range(int(len(t) * share)):
            i = rng.randrange(len(t))
            t[i:i + 1] = rng.choice([[], [t[i], "q"], ["z"]])
        return "".join(t)

    noise = lambda: " ".join(words(rng, 120))
    texts = {i: f"{noise()} {items[i % 3]} {noise()}" for i in range(6)}
    texts |= {10 + i: f"{noise()}\n{edited(items[i % 3], 0.03)}\n{noise()}" for i in range(9)}
    texts |= {20 + i: f"{noise()}, {items[i].upper().replace(' ', '  ')}." for i in range(3)}
    texts |= {30 + i: noise() for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {k: [k % 10 % 3] if k < 30 else [] for k in texts}


@pytest.mark.parametrize("n", [13, 15, 18, 20])
def test_quotes_of_some_words_are_found_at_every_offset(spark, n):
    rng = random.Random(n)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    items.append((-1, " ".join(rng.choice("ab") + str(rng.randrange(9)) for _ in range(60))))  # 13 words of 26 bytes
    block = decontam.Block.of(items)
    texts, want = [], []
    for item, text in items:
        w = text.split()
        for i in range(len(w) - n + 1):
            texts.append(" ".join(["0zq"] * rng.randrange(9) + w[i:i + n] + ["qz0"] * 3))
            want.append(item)
    off, data, head = decontam.squash(pa.array(texts))
    found = defaultdict(set)
    for r, item, _ in decontam.matches(block, off, data) + decontam.phrases(block, off, data, head):
        found[r].add(item)
    assert len(texts) > 500 and [i for i, item in enumerate(want) if item not in found[i]] == []


def test_short_items_match_whole_words(spark):
    docs = {1: "So: Kalo, MITU!", 2: "so kalomitu", 3: "skalo mitu", 4: "kalo mitus", 5: "kalo", 6: "kalo mitu", 7: None}
    got = decontam.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"),
                                 spark.createDataFrame([(3, "kalo mitu"), (4, "?!")], "item_id bigint, text string"))
    assert {r["doc_id"]: (r["item_ids"], r["least_edits"]) for r in got.collect()} == {
        i: ([3], 0) if i in (1, 6) else ([], None) for i in docs}


def test_repetitive_texts_and_items_take_bounded_work():
    block = decontam.Block.of([(1, "lo" * 300), (2, " ".join(["lo"] * 300)), (3, "lo" * 40 + "xy" + "lo" * 40)])
    assert len(block.owner) < 2000  # windows of equal bytes are one
    off, data, _ = decontam.squash(pa.array(["lo" * 500_000, "lo" * 20]))
    tracemalloc.start()
    began = time.monotonic()
    got = decontam.matches(block, off, data)
    took, peak = time.monotonic() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1, 0), (0, 2, 0), (0, 3, 0)] and took < 60 and peak < 500 << 20


@pytest.mark.parametrize("postings, size", [(1 << 18, 2 << 20), (50, 2 << 20), (1 << 18, 300), (50, 300)])
def test_pieces_give_the_same(spark, monkeypatch, postings, size):
    rng = random.Random(21)
    items = [" ".join(words(rng, n)) for n in (15, 30, 200)]
    texts = [" ".join(words(rng, 400)) for _ in range(6)]
    for i, t in enumerate(texts[:4]):
        a = rng.randrange(len(t))
        texts[i] = t[:a] + " " + items[i % 3][:150].replace("k", "", i) + " " + t[a:]
    texts[4] += " " + "abcdefgh" * 400 + " " + items[2]
    docs = spark.createDataFrame([*enumerate(texts), (6, None), (0, texts[0])], "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, "abcdefgh" * 50)], "item_id bigint, text string")
    want = sorted(map(tuple, decontam.decontaminate(docs, bench).collect()))
    assert [x[2] for x in want] == [[0], [0], [1], [2], [0], [2, 9], [], []]
    monkeypatch.setattr(decontam, "POSTINGS", postings)
    monkeypatch.setattr(decontam, "SLICE_BYTES", size)
    block = decontam.Block.of(sorted([*enumerate(items), (9, "abcdefgh" * 50)]))
    off, data, _ = decontam.squash(pa.array(texts))
    found = defaultdict(dict)
    for a, z, x, y in decontam._pieces(off):
        for r, item, e in decontam.matches(block, np.clip(off[a:z + 1], x, y) - x, data[x:y]):
            found[a + r][item] = min(e, found[a + r].get(item, e))
    assert {(r, tuple(sorted(x)), min(x.values())) for r, x in found.items()} == {
        (x[0], tuple(x[2]), x[3]) for x in want if x[2]}


def test_blocks_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontam.decontaminate(docs, bench).select("doc_id", "item_ids").collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert one == sorted(map(tuple, decontam.decontaminate(docs, bench).select("doc_id", "item_ids").collect()))


def test_banded_alignment_is_edit_distance():
    rng = random.Random(2)
    pattern = "".join(rng.choice("abcd") for _ in range(60))
    block = decontam.Block.of([(1, pattern)])
    for _ in range(50):
        t = list(pattern)
        for _ in range(rng.randrange(7)):
            i = rng.randrange(len(t))
            t[i:i + 1] = rng.choice([[], [t[i], "a"], ["b"]])
        text = "xy" * 10 + "".join(t) + "yx" * 10
        row = [0] * (len(text) + 1)
        for c in pattern:  # the ends of the text are free
            new = [row[0] + 1]
            for j, x in enumerate(text):
                new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
            row = new
        data = np.frombuffer(text.encode(), np.uint8)
        got = decontam.align(block, np.array([0, len(data)]), data, np.array([0]), np.array([0]),
                             np.array([20 - block.band]))
        assert got[0] == min(row) or min(row) > block.budget[0]


# ---------------------------------------------------------------- 4

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randint(0, 700))) for _ in range(150)]
    texts += [None, "", " ", "  two  spaces ", "tab\t x\n y", "it's <|endoftext|> don't 12 34", "é ñ 漢字   z",
              "a" * 9000, "\n\n \n", "x  y", "ª º ǅ", "end\n"]
    rows = list(enumerate(texts))
    cap = 256
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer_path(), cap).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    total = 0
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ps = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(-(-len(ids) // cap)))
        assert all(p["length"] == cap for p in ps[1:])
        at = 0
        for p in ps:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:j]) for j in range(len(rs))]
        assert sum(r["length"] for r in rs) <= cap
    assert len(by_seq) <= 1.03 * math.ceil(total / cap) + 1


def left_over(types, cap):
    """An exchange of at most three pieces between underfull bins that raises the squares."""
    some = lambda t: [g for n in (1, 2) for g in itertools.combinations(t, n)]
    under = {t: n for t, n in types.items() if sum(t) < cap}
    for a in under:
        for b in under:
            if a == b and under[a] < 2:
                continue
            for x in some(a):
                for y in [(), *some(b)]:
                    d = sum(x) - sum(y)
                    if len(x) + len(y) <= 3 and 0 < d <= cap - sum(b) and sum(b) - sum(a) + d > 0:
                        return a, b, x, y


def test_bins_of_many_pieces_exchange_two_for_one():
    assert packing._groups((7, 5, 5) + (1,) * 80) == {
        1: (1,), 2: (1, 1), 5: (5,), 6: (1, 5), 7: (7,), 8: (1, 7), 10: (5, 5), 12: (5, 7)}
    # in the bin of 72 pieces only 3 + 3 leave room for the 7: two for one
    many = (3, 3) + (2,) * 70
    bins = packing._Bins({(7,): 1, many: 1}, 147)
    assert bins.best(bins.at[7,]) == (bins.at[many], 7, 6)


def test_local_search_keeps_pieces_and_saves_bins():
    rng = random.Random(1)
    for _ in range(30):
        hist = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 400)))
        first = packing.best_fit(dict(hist), 100)
        last = packing.local_search(first, 100)
        for types in (first, last):
            assert Counter({x: 0 for x in hist}) + sum((Counter({x: n * t.count(x) for x in t}) for t, n in types.items()),
                                                     Counter()) == hist
            assert all(sum(t) <= 100 and n > 0 for t, n in types.items())
        assert sum(last.values()) <= sum(first.values())
        if sum(last.values()) > math.ceil(sum(x * n for x, n in hist.items()) / 100):
            assert not left_over(last, 100)
    # six of two kinds: best fit needs a third bin, an exchange empties it
    assert sum(packing.local_search({(60, 30): 1, (50, 40): 1, (10, 10): 1}, 100).values()) == 2


# ---------------------------------------------------------------- 6

def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("occupancy", [4, 1 / 256])  # the second makes three segments of them
def test_simhash_components(spark, odd_rows, monkeypatch, occupancy):
    if occupancy < 1:
        monkeypatch.setattr(simhash, "segment_plan",
                            lambda n, r: [(0, 21, 1), (21, 21, 1), (42, 22, 0)])
    rng, rows = random.Random(6), [(r[0], r[1]) for r in odd_rows]
    for g in range(20):
        w = words(rng, 150)
        for j in range(rng.randint(1, 8)):
            x = list(w)
            for _ in range(j):
                x[rng.randrange(len(x))] = "q"
            rows.append((100 + 10 * g + j, " ".join(x)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    fps = {t: brute_fingerprint(t) for _, t in rows}
    link = {f: f for f in fps.values()}

    def root(f):
        while link[f] != f:
            f = link[f]
        return f

    for a in list(link):
        for b in list(link):
            if (a ^ b).bit_count() <= 4:
                link[root(a)] = root(b)
    low = {}
    for i, t in rows:
        if i is not None:
            low[root(fps[t])] = min(low.get(root(fps[t]), i), i)
    want = sorted((str(i), f"{fps[t]:016x}", str(low.get(root(fps[t])))) for i, t in rows)
    assert want == sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got)


def test_dense_bucket_keeps_its_component():
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2 ** 63))
    fps = np.unique(np.array([base ^ int(sum(1 << int(b) for b in rng.choice(48, 2, False))) for _ in range(400)], np.uint64))
    found = simhash._bucket_links(np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int32), fps, 4)
    assert len(found) == len(fps) - 1  # all within four bits: one tree


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    link = {x: x for e in edges for x in e}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        link[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in link if x not in loops}


# ---------------------------------------------------------------- 7

def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert sum(got[k]["lang_pred"] == truth[k] for k in held) >= 0.98 * len(held)


def test_codewords():
    for k in range(1, 12):
        c = langid.codewords(k)
        assert len({tuple(x) for x in c.tolist()}) == k
        assert k == 1 or not (np.abs(c.sum(0)) == k).any()


# ---------------------------------------------------------------- 8

@pytest.mark.parametrize("n", [1, 7, 24])
def test_shards(spark, n):
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randint(1, 60))) for _ in range(400)] + ["copy of a text"] * 200 + [None, ""]
    rows = list(enumerate(texts))
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), n).collect()
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode())
        by_shard[r["shard"]].append(r)
        by_text[t].add(r["shard"])
    assert len(got) == len(rows)
    for rs in by_shard.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    sizes = [sum(r["size"] for r in by_shard[s]) for s in range(n)]
    assert max(abs(s - total / n) for s in sizes) <= 2 * largest + 2 * sharding.GROUP_SLACK * total / n
    assert all(len(x) == 1 for t, x in by_text.items() if t != "copy of a text")


# ---------------------------------------------------------------- 9

def test_language_model(spark):
    rng = random.Random(12)
    pairs = {w: words(rng, 3) for w in words(rng, 40)}
    texts = []
    for _ in range(1500):
        w = []
        for _ in range(rng.randint(0, 60)):
            a = rng.choice(list(pairs))
            w += [a, pairs[a][0]]   # a word that tells the next
        texts.append(" ".join(w))
    texts += [None, "", "Never seen WORDS", "tab\tand space"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in gru_lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")
                                                          .repartition(4)).collect()}
    toks = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    held = {i for i in toks if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(t for i, x in toks.items() if i not in held for t in x)
    n, v = sum(c.values()), len(c)
    for i, x in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            i in held, len(x), sum(c[t] > 0 for t in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x))
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held) + 0.02 * sum(
        got[i]["n_tokens"] for i in held)


def test_head_and_shuffled_counts_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    one = {r["doc_id"]: r for r in gru_lm.score_documents(docs).collect()}
    monkeypatch.setattr(gru_lm, "HEAD", 1100)  # nearly all words through the join
    for r in gru_lm.score_documents(docs).collect():
        assert r["n_known"] == one[r["doc_id"]]["n_known"]
        assert r["base_score"] == pytest.approx(one[r["doc_id"]]["base_score"])


def test_model_is_a_distribution_with_right_gradients():
    rng = np.random.default_rng(0)
    v = gru_lm.Vocabulary([b""] + [str(i).encode() for i in range(gru_lm.WORDS - 1)],
                          rng.integers(1, 50, gru_lm.WORDS).astype(float), 10_000, 2000,
                          np.full(gru_lm.TAILS, 7.0), np.full(gru_lm.TAILS, 3.0))
    p = gru_lm.initial(v)
    h = rng.normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    symbols = np.arange(gru_lm.WORDS + gru_lm.TAILS)
    lp, _ = gru_lm.output(p, np.repeat(h, len(symbols), 0), symbols)
    assert np.exp(lp).sum() == pytest.approx(1, abs=1e-4)

    p = {k: x.astype(np.float64) for k, x in p.items()}
    y = rng.integers(0, len(symbols), (3, 6)).astype(np.int32)
    x = np.concatenate([np.full((3, 1), gru_lm.START), y[:, :-1]], 1)
    x[1, 3] = gru_lm.START
    fresh = x == gru_lm.START

    def loss(q, grad=None):
        kept = []
        s = gru_lm.forward(q, x, fresh, np.zeros((3, gru_lm.HIDDEN)), kept)
        lp, dh = gru_lm.output(q, s.reshape(-1, gru_lm.HIDDEN), y.T.ravel(), grad)
        if grad is not None:
            gru_lm.backward(q, x, fresh, kept, dh.reshape(s.shape), grad)
        return -lp.mean()

    grad = {k: np.zeros_like(a) for k, a in p.items()}
    loss(p, grad)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(grad[k])), p[k].shape)
        step, value = 1e-2, []
        for d in (step, -step):
            q = {n: a.copy() for n, a in p.items()}
            q[k][at] += d
            value.append(loss(q))
        assert (value[0] - value[1]) / (2 * step) == pytest.approx(grad[k][at], rel=0.05, abs=1e-5), k


def test_every_training_token_gives_a_gradient():
    v = gru_lm.Vocabulary([str(i).encode() for i in range(gru_lm.WORDS)], np.ones(gru_lm.WORDS), gru_lm.WORDS,
                          gru_lm.WORDS, np.ones(gru_lm.TAILS), np.ones(gru_lm.TAILS))
    first = gru_lm.initial(v)
    p = {k: x.copy() for k, x in first.items()}
    docs = [np.arange(5 * gru_lm.WINDOW, dtype=np.int32)]  # each symbol once, window after window
    assert gru_lm.train(p, gru_lm.Adam(p), docs) == 5
    assert (p["E"] != first["E"]).any(1)[:5 * gru_lm.WINDOW - 1].all()


def test_streams_keep_documents_whole():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1000, n).astype(np.int32) for n in rng.integers(1, 200, 90)]
    v = gru_lm.Vocabulary([b""], np.ones(1), 1, 1, np.ones(gru_lm.TAILS), np.ones(gru_lm.TAILS))
    p = gru_lm.initial(v)
    p["bw"][:] = 0
    alone = [gru_lm.log_likelihoods(p, [d])[0] for d in docs]
    assert gru_lm.log_likelihoods(p, docs) == pytest.approx(alone, rel=1e-4)


def test_a_very_long_document_among_short_ones_pads_nothing():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 1000, n).astype(np.int32) for n in [300_000, *[20] * 255]]
    v = gru_lm.Vocabulary([b""], np.ones(1), 1, 1, np.ones(gru_lm.TAILS), np.ones(gru_lm.TAILS))
    p = gru_lm.initial(v)
    p["bw"][:] = 0
    tracemalloc.start()
    got = gru_lm.log_likelihoods(p, docs)
    gru_lm.train({k: x.copy() for k, x in p.items()}, gru_lm.Adam(p), docs[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # padded to the longest, the streams alone would take 900 MB
    assert got[1:] == pytest.approx(gru_lm.log_likelihoods(p, docs[1:]), rel=1e-4)
    laid = gru_lm.Streams.of(docs, 8)
    places = np.concatenate([at for _, _, at in laid.windows()])
    assert np.array_equal(np.sort(places), np.arange(sum(map(len, docs))))  # each token once


# ---------------------------------------------------------------- 10

def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    c = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if c[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [pfp_dedup.HOT, 2])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(pfp_dedup, "HOT", hot)
    rng = random.Random(10)
    passages = [" ".join(words(rng, n)) for n in (30, 60, 200)] + ["é" * 150, "ab" * 200, "z" * 199, "y" * 200, "w" * 201]
    texts = [None, "", "short", "ñ" * 99, "ñ" * 100, "q" * 200, "q" * 200]
    for i in range(60):
        parts = [" ".join(words(rng, rng.randint(5, 120)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(20)
            parts += [p[a:len(p) - rng.randrange(20)], " ".join(words(rng, 9))]
        texts.append(" ".join(parts))
    line = " ".join(words(rng, 16)) + "\n"   # many different texts around it
    texts += [" ".join(words(rng, 30)) + line + " ".join(words(rng, 30)) for _ in range(30)]
    texts += texts[10:20] + [texts[30] * 2] + texts[70:90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: tuple(r)[1:5] for r in pfp_dedup.remove_repeats(docs, 200).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))
    kept = {r["doc_id"]: r["text"] for r in pfp_dedup.cut_repeats(docs, 200).collect()}
    for i, t in enumerate(texts):
        n = len((t or "").encode()) - got[i][1]
        assert n <= len((kept[i] or "").encode()) <= n + 6 * got[i][2]  # only broken characters stay
    assert kept[0] is None and kept[3] == texts[3]


def test_triggers_depend_on_content_only():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    one, two = pfp_dedup.triggers(data), pfp_dedup.triggers(data[777:])
    assert (one[777:] - 777 == two).all()
    assert ((one >= np.arange(len(one))) & (one < np.arange(len(one)) + pfp_dedup.REACH)).all()


def test_pipeline_drops_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(20)
    clean = {i: " ".join(words(rng, 120 + 300 * (i == 1))) for i in range(30)}
    bench = [(0, " ".join(words(rng, 40)))]
    shared = " ".join(words(rng, 70))
    rows = dict(clean)
    rows |= {40: clean[0], 41: clean[1] + " end", 50: f"{' '.join(words(rng, 60))} {bench[0][1]} {' '.join(words(rng, 60))}",
             60: f"{' '.join(words(rng, 60))} {shared}", 61: f"{shared} {' '.join(words(rng, 60))}", 70: "", 71: "12 34"}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in got.collect()}
    assert ids == {*clean, 60, 61}
    text = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut = {r["doc_id"]: r["text"] for r in pfp_dedup.cut_repeats(text, 200).where(F.col("doc_id").isin(60, 61)).collect()}
    assert all(shared[10:-10] not in t for t in cut.values())


def test_utf8_of_slices():
    from jobtrails.llm.common import slices, utf8

    arr = pa.array(["ab", None, "é", "", "xyz"])
    off, data = utf8(arr.slice(1, 4))
    assert off.tolist() == [0, 0, 2, 2, 5] and data.tobytes() == "éxyz".encode()
    assert [x for a, z in slices(off, 2) for x in range(a, z)] == [0, 1, 2, 3]

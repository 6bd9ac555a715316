"""Language identification against plain Python, step by step on a hundred short texts."""

import random
import zlib
from collections import Counter, defaultdict
from math import exp, log, log1p, sqrt

import pytest

from jobtrails.llm import langid
from tests.llm.conftest import rows_of

STEMS = {"aa": "ka lo mi tu re sa", "bb": "the ing or and tion", "cc": "öl ük äb ßt schr ei", "dd": "zo vni ъь щи ж ка"}


def buckets(text):
    """One bucket for each four bytes of the folded text, but for runs of spaces."""
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in f" {(text or '').lower()} ".encode())
    out = []
    for i in range(len(raw) - 3):
        if not raw[i] == raw[i + 1] == 32:
            out.append(int.from_bytes(raw[i:i + 4], "little") * 2654435761 % 2**32 >> 14)
    return out


def plain(rows):
    """(lang_pred, score, ambiguous) of every text."""
    train = [(t, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 5 and t is not None and lang is not None]
    langs = sorted({lang for _, lang in train})
    counts = {x: Counter() for x in langs}
    for t, lang in train:
        counts[lang].update(buckets(t))
    total = {x: sum(c.values()) + langid.SMOOTHING * langid.N_BUCKETS for x, c in counts.items()}
    codes = langid.codewords(len(langs))

    def bits(text):
        ids, out = buckets(text), []
        for i in range(codes.shape[1]):
            mean = {s: lambda b, s=s, i=i: sum((counts[x][b] + langid.SMOOTHING) / total[x]
                                                for x, c in zip(langs, codes[:, i]) if c == s) / (codes[:, i] == s).sum()
                    for s in (1, -1)}
            out.append(sum(log(mean[1](b)) - log(mean[-1](b)) for b in ids) / sqrt(max(len(ids), 1)))
        return out

    hits, n = defaultdict(float), Counter()
    for t, lang in train:
        n[lang] += 1
        for i, f in enumerate(bits(t)):
            hits[lang, i] += (f > 0) - (f < 0) == codes[langs.index(lang), i]
    trust = []
    for x in langs:
        w = [(hits[x, i] + 1) / (n[x] + 2) for i in range(codes.shape[1])]
        trust.append([v / sum(w) for v in w])

    out = []
    for _, t, _ in rows:
        if not any(ch.isalpha() for ch in t or ""):
            out.append(("und", 0.0, True))
            continue
        f = bits(t)
        loss = [sum(w * (log1p(exp(-abs(c * v))) + max(-c * v, 0)) for w, c, v in zip(trust[k], codes[k], f))
                for k in range(len(langs))]
        p = [exp((min(loss) - x) * codes.shape[1]) for x in loss]
        p = [x / sum(p) for x in p]
        order = sorted(p)
        out.append((langs[p.index(max(p))], max(p), order[-1] - order[-2] < langid.MIN_MARGIN))
    return out


def test_decisions_and_scores(make):
    rng = random.Random(6)
    texts, langs = [], {}
    for i in range(100):
        lang = rng.choice(list(STEMS))
        stems = (STEMS[lang] + (" " + STEMS["aa"]) * (i % 9 == 0)).split()
        words = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 25))]
        texts.append("  ".join(words).title() + rng.choice(["", "!", " 12, 3", "\n"]))
        langs[i] = lang if i % 11 else None
    texts += [None, "", "123 %%", "a", "é", "Ab  cd"]
    docs = rows_of(texts, langs)
    want = plain([r[:3] for r in docs])
    got = {r["doc_id"]: r for r in langid.identify(make(rows=docs)).collect()}
    assert {w[0] for w in want} >= {*STEMS, "und"}
    for i, (lang, score, ambiguous) in enumerate(want):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=2e-3), (i, texts[i])
        if abs(got[i]["margin"] - langid.MIN_MARGIN) > 2e-3:
            assert got[i]["ambiguous"] == ambiguous

"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are squashed: lower case, ASCII letters, digits and non-ASCII bytes only.
Windows of ``WINDOW`` bytes start at every word of a benchmark item and at every
``STEP``-th byte (a shorter item is one window), and ``PHRASE`` words that are
shorter than that are windows too, so that a quote of ``PHRASE`` words holds a
whole window wherever it begins.  A passage within k edits of a window of n bytes
shares at least n - q + 1 - k q of its q-grams with it (the q-gram lemma), and
they lie on diagonals at most k apart.  So shared q-grams of a text and an item
are counted in diagonal bands of twice the width B > k that overlap by half, then
by window in the bands that can reach a bound; windows that reach theirs are
aligned within the band, and one matches if at most k edits are left.  Windows
that can't be better than a match of the same item in the text aren't aligned.

What is shorter than ``MIN_BYTES`` (a whole item, or ``PHRASE`` words of one)
matches the same words only, with no edits, from word to word.

Windows of equal bytes in one item are one window, and only q-grams that a window
holds are indexed, so a repetitive item has a small index.  Places in the texts are
taken ``POSTINGS`` entries of the index at a time, with an overlap as long as a match;
an item that a text holds without edits isn't looked for in the rest of it.

The benchmark is the query set.  It is sent to the tasks in blocks of about
``BLOCK_BYTES``, one pass over the documents for each block; of more than one block
the matches are written and the block is freed before the next.

Edge cases: a null or empty text matches nothing.  A null item or one without a
letter or digit is skipped; an item of one word matches every text with that word.
Repeated documents are each judged, repeated items count once per item_id.  No
items: no document is contaminated; no documents: an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtrails.llm.common import materialise, shield, slices, utf8

Q = 8
WINDOW = 64
STEP = 8
PHRASE = 13
EDIT_SHARE = 0.1
MIN_BYTES = 32
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 2 << 20
HITS = 1 << 16
POSTINGS = 1 << 18
OVERLAP = 2 * WINDOW  # a match is shorter
_FILTER_BITS = 22
_KEEP = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_DROP = bytes(np.flatnonzero(~_KEEP).tolist())


def squash(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and bytes of the squashed texts, and whether a word begins at a byte."""
    off, data = utf8(pc.utf8_lower(texts.fill_null("").cast(pa.string())))
    keep = _KEEP[data]
    head = keep.copy()
    head[1:] &= ~keep[:-1]
    size = [np.count_nonzero(keep[a:z]) for a, z in zip(off.tolist(), off[1:].tolist(), strict=False)]
    off, data, head = np.cumsum([0, *size]), data[keep], head[keep]
    head[off[off < len(head)]] = True
    return off, data, head


def qgrams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer."""
    n = max(len(data) - Q + 1, 0)
    out = np.empty(n, np.uint64)
    raw = data.tobytes()
    for k in range(min(Q, n)):
        count = len(range(k, n, Q))
        out[k::Q] = np.frombuffer(raw, "<u8", count, k)
    return out


def _spans(text: str, size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """First and last places of an item's windows, and of its short phrases."""
    words = [n for w in pc.utf8_lower(text).as_py().encode().split() if (n := len(w.translate(None, _DROP)))]
    at = np.cumsum([0, *words]).tolist()
    if size < MIN_BYTES:
        return [], [(0, size)]
    last = max(size - WINDOW, 0)
    windows = {(a, min(a + WINDOW, size)) for a in [*range(0, last, STEP), *(a for a in at if a < last), last]}
    phrases = {(a, z) for a, z in zip(at, at[PHRASE:], strict=False) if z - a < WINDOW} - windows
    short = {x for x in phrases if x[1] - x[0] < MIN_BYTES}
    return sorted(windows | phrases - short), sorted(short)


@dataclass
class Block:
    """Some items, the index of their q-grams, their windows and short phrases."""

    ids: np.ndarray       # item_id of each item
    least: np.ndarray     # and the fewest shared q-grams of its windows
    data: np.ndarray      # bytes of all items
    base: np.ndarray      # first byte of each
    item: np.ndarray      # item of each window, ascending
    start: np.ndarray     # place in the item, ascending within it
    size: np.ndarray
    budget: np.ndarray    # edits
    need: np.ndarray      # shared q-grams
    grams: np.ndarray     # distinct, sorted
    first: np.ndarray     # postings of gram i: first[i] .. first[i + 1]
    owner: np.ndarray     # item and place of each posting
    place: np.ndarray
    filter: np.ndarray
    band: int
    longest: int
    short: dict[tuple[bytes, bytes], list[int]]   # bytes and word beginnings -> item_ids
    heads: dict[int, np.ndarray]                  # size -> distinct first bytes

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Block | None:
        ids, windows, whole, short, grams, owner, place = [], [], [], {}, [], [], []
        off, data, head = squash(pa.array([t for _, t in items], pa.string()))
        for i, (item, text) in enumerate(items):
            x, begins = data[off[i]:off[i + 1]], head[off[i]:off[i + 1]]
            if not len(x):
                continue
            spans, phrases = _spans(text, len(x))
            for a, z in phrases:
                short.setdefault((x[a:z].tobytes(), begins[a:z].tobytes()), []).append(item)
            if not spans:
                continue
            raw, edge = x.tobytes(), np.zeros(len(x) + 1, np.int32)
            spans = sorted({raw[a:z]: (a, z) for a, z in reversed(spans)}.values())  # the first of equal ones
            for a, z in spans:
                n = z - a
                # a phrase keeps as many shared q-grams as a window of full size
                budget = int(min(n * EDIT_SHARE, (n - 2 * Q) // Q if n < min(WINDOW, len(x)) else n))
                windows.append((len(ids), a, n, budget))
                edge[a] += 1
                edge[z - Q + 1] -= 1
            at = np.flatnonzero(np.cumsum(edge))
            grams.append(qgrams(x)[at])
            owner.append(np.full(len(at), len(ids), np.int32))
            place.append(at.astype(np.int32))
            ids.append(item)
            whole.append(x)
        if not ids and not short:
            return None
        heads: dict[int, set[int]] = {}
        for x, _ in short:
            heads.setdefault(len(x), set()).add(int.from_bytes(x[:Q], "little"))
        item, start, size, budget = np.array(windows, np.int32).reshape(-1, 4).T.copy()
        need = size - Q + 1 - budget * Q
        least = np.full(len(ids), WINDOW)
        np.minimum.at(least, item, need)
        bytes_ = np.array([len(x) for x in whole], np.int64)
        flat = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        none = np.empty(0, np.int32)
        block = cls(np.array(ids, np.int64), least, np.concatenate([np.empty(0, np.uint8), *whole]),
                    np.cumsum(bytes_) - bytes_, item, start, size, budget, need, grams, np.append(first, len(flat)),
                    np.concatenate([none, *owner])[order], np.concatenate([none, *place])[order],
                    np.zeros(1 << _FILTER_BITS, bool), int(budget.max(initial=0)) + 1, int(bytes_.max(initial=0)), short,
                    {n: np.array(sorted(x), np.uint64) for n, x in heads.items()})
        block.filter[_slot(grams)] = True
        return block


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


def hits(block: Block, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, indexed q-gram, text) of the places whose q-gram the index holds."""
    g = qgrams(data)
    at = np.flatnonzero(block.filter[_slot(g)])
    i = np.searchsorted(block.grams, g[at])
    hit = block.grams[np.minimum(i, len(block.grams) - 1)] == g[at]
    at, i = at[hit], i[hit]
    row = np.searchsorted(off, at, "right") - 1
    inside = at + Q <= off[row + 1]
    return at[inside], i[inside], row[inside]


def candidates(block: Block, at: np.ndarray, i: np.ndarray, row: np.ndarray, settled: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, first diagonal, shared q-grams) of the bands with enough of
    the hits, but for the (text, item) pairs ``settled``."""
    n = block.first[i + 1] - block.first[i]
    post = np.repeat(block.first[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pair, place = np.repeat(row, n) * len(block.ids) + block.owner[post], block.place[post].astype(np.int64)
    at = np.repeat(at, n)
    if len(settled):
        open_ = settled[np.minimum(np.searchsorted(settled, pair), len(settled) - 1)] != pair
        pair, place, at = pair[open_], place[open_], at[open_]
    shift = block.longest + block.band  # an item may start before the first text
    band = (at - place + shift) // block.band
    base = int(band.max(initial=0)) + 2
    key = pair * base + band
    key, place = np.concatenate([key, key - 1]), np.concatenate([place, place])  # bands are two wide
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    run = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(run, append=len(key))
    some = size >= block.least[key[run] // base % len(block.ids)]
    run, size = run[some], size[some]
    # the windows that hold each q-gram of these bands, some bands at a time
    wide = block.longest + WINDOW
    windows = block.item.astype(np.int64) * wide + block.start
    out = [[np.empty(0, np.int64)] * 4]
    for part in np.split(np.arange(len(run)), np.flatnonzero(np.diff(np.cumsum(size) // HITS)) + 1):
        m = size[part]
        band = np.repeat(part, m)
        hits = np.repeat(run[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        s, item = place[hits], key[hits] // base % len(block.ids)
        low = np.searchsorted(windows, item * wide + np.maximum(s + Q - WINDOW, 0), "left")
        n = np.searchsorted(windows, item * wide + s, "right") - low
        w = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inside = np.repeat(s, n) + Q <= block.start[w] + block.size[w]
        pair, count = np.unique(np.repeat(band, n)[inside] * len(windows) + w[inside], return_counts=True)
        w, k = pair % len(windows), key[run[pair // len(windows)]]
        some = count >= block.need[w]
        w, k = w[some], k[some]
        out.append([k // base // len(block.ids), w, k % base * block.band - shift + block.start[w], count[some]])
    row, window, diagonal, count = map(np.concatenate, zip(*out, strict=True))
    return row, window, diagonal, count


def align(block: Block, off: np.ndarray, data: np.ndarray, row: np.ndarray, window: np.ndarray,
          diagonal: np.ndarray) -> np.ndarray:
    """Least edits of each window within its band of its text, the ends of the
    text free; all candidates advance together, one window byte at a time."""
    width = 2 * block.band + 2 * block.band  # the band and the budget to either side
    best = np.full(len(row), WINDOW)
    size = block.size[window]
    first = block.base[block.item[window]] + block.start[window]
    for a in range(0, len(row), 4096):
        part = slice(a, a + 4096)
        m = len(row[part])
        low, high = off[row[part]], off[row[part] + 1]
        pattern = block.data[np.minimum(first[part, None] + np.arange(WINDOW), len(block.data) - 1)]
        start = diagonal[part] - block.band
        span = np.arange(width)
        cost = np.zeros((m, width), np.int32)
        for i in range(int(size[part].max())):
            place = start[:, None] + span + i
            ok = (place >= low[:, None]) & (place < high[:, None])
            same = ok & (data[np.clip(place, 0, len(data) - 1)] == pattern[:, i:i + 1])
            step = cost + ~same                       # match or replace
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)   # window byte left out
            step = np.minimum.accumulate(step - span, axis=1) + span   # text bytes left out
            cost = np.where((i < size[part])[:, None], step, cost)
        best[part] = cost.min(1)
    return best


def matches(block: Block, off: np.ndarray, data: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item_id, least edits) of the items that a window of each text matches."""
    if not len(block.ids):
        return []
    at, gram, row = hits(block, off, data)
    postings = np.cumsum(block.first[gram + 1] - block.first[gram])
    cuts = (np.flatnonzero(np.diff(postings // POSTINGS)) + 1).tolist()
    best: dict[int, int] = {}  # (text, item) -> edits
    settled = np.empty(0, np.int64)
    for a, z in zip([0, *cuts], [*cuts, len(at)], strict=True):
        if a == z:
            continue
        part = slice(int(np.searchsorted(at, at[a] - OVERLAP)), z)
        _improve(block, off, data, candidates(block, at[part], gram[part], row[part], settled), best)
        settled = np.array(sorted(k for k, e in best.items() if not e), np.int64)
    return [(k // len(block.ids), int(block.ids[k % len(block.ids)]), e) for k, e in sorted(best.items())]


def _improve(block: Block, off: np.ndarray, data: np.ndarray, found: tuple[np.ndarray, ...], best: dict[int, int]) -> None:
    """Align the candidates ``found`` that can be better than ``best``, and keep what is."""
    row, window, diagonal, count = found
    pair, group = np.unique(row * len(block.ids) + block.item[window], return_inverse=True)
    fewest = -(-(block.size[window] - Q + 1 - count) // Q)  # edits, by the lemma
    least = np.array([best.get(k, WINDOW) for k in pair.tolist()], np.int64)
    before = least.copy()
    order = np.lexsort([fewest, group])
    order = order[np.diff(group[order], prepend=-1) > 0]  # the likeliest of each pair, then what may be better
    for turn in range(2):
        some = np.setdiff1d(np.arange(len(row)), order) if turn else order
        some = some[fewest[some] < least[group[some]]]
        edits = align(block, off, data, row[some], window[some], diagonal[some])
        good = edits <= block.budget[window[some]]
        np.minimum.at(least, group[some][good], edits[good])
    better = least < before
    best.update(zip(pair[better].tolist(), least[better].tolist(), strict=True))


def phrases(block: Block, off: np.ndarray, data: np.ndarray, head: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item_id, 0) of the short items and phrases that a text holds word by word."""
    out = []
    if not block.heads:
        return out
    at = np.flatnonzero(head)
    row = np.searchsorted(off, at, "right") - 1
    padded, g = np.concatenate([data, np.zeros(Q, np.uint8)]), np.zeros(len(at), np.uint64)
    for k in range(Q):
        g |= padded[at + k].astype(np.uint64) << np.uint64(8 * k)
    ends = np.append(head, True)
    for n, first in block.heads.items():
        some = np.flatnonzero(at + n <= off[row + 1])
        some = some[ends[at[some] + n]]
        x = g[some] & np.uint64((1 << 8 * min(n, Q)) - 1)
        some = some[first[np.minimum(np.searchsorted(first, x), len(first) - 1)] == x]
        for a, r in zip(at[some].tolist(), row[some].tolist(), strict=True):
            out += [(r, i, 0) for i in block.short.get((data[a:a + n].tobytes(), head[a:a + n].tobytes()), [])]
    return out


def match(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, item_ids (sorted) and least_edits (null: no match) of every document."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES) or 1
    ids = F.array().cast("array<bigint>").alias("item_ids")
    least = F.lit(None).cast("int").alias("least_edits")
    if n_blocks == 1:
        block = Block.of(sorted(map(tuple, items.collect())))
        text = [] if "text" in keep else ["text"]
        found = docs.select(*keep, *text, ids, least)
        return (_one_block(found, docs.sparkSession.sparkContext.broadcast(block)) if block else found).drop(*text)
    return _many_blocks(docs, items, n_blocks, keep)


def _many_blocks(docs: DataFrame, items: DataFrame, n_blocks: int, keep: list[str]) -> DataFrame:
    """As match(): the matches of each block are written by the texts' digests,
    and joined to the documents."""
    spark, key = docs.sparkSession, F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    texts = docs.select(key.alias("__key"), "text", F.array().cast("array<bigint>").alias("item_ids"),
                        F.lit(None).cast("int").alias("least_edits"))
    parts = []
    for i in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).collect()
        block = Block.of(sorted(map(tuple, part)))
        if block:
            shared = spark.sparkContext.broadcast(block)
            parts.append(materialise(_one_block(texts, shared).where(F.size("item_ids") > 0).drop("text").distinct(),
                                     "leaks"))
            shared.destroy()
    if not parts:
        return docs.select(*keep, F.array().cast("array<bigint>").alias("item_ids"),
                           F.lit(None).cast("int").alias("least_edits"))
    found = reduce(DataFrame.union, parts).groupBy("__key").agg(
        F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.min("least_edits").alias("least_edits"))
    return docs.select(*keep, key.alias("__key")).join(found, "__key", "left").select(
        *keep, F.array_distinct(F.coalesce("item_ids", F.array().cast("array<bigint>"))).alias("item_ids"), "least_edits")


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, first byte, last byte): whole texts of about
    SLICE_BYTES, and longer ones in overlapping parts."""
    for a, z in slices(off, SLICE_BYTES):
        first, last = int(off[a]), int(off[z])
        step = SLICE_BYTES if z == a + 1 else max(last - first, 1)
        for x in range(first, max(last, first + 1), step):
            yield a, z, max(first, x - OVERLAP), min(last, x + step)


def _one_block(docs: DataFrame, shared) -> DataFrame:
    out = StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            ids, least = b["item_ids"].to_pylist(), b["least_edits"].to_pylist()
            off, data, head = squash(b["text"])
            found = defaultdict(dict)  # text -> item -> edits
            for a, z, x, y in _pieces(off):
                for r, item, e in matches(block, np.clip(off[a:z + 1], x, y) - x, data[x:y]):
                    found[a + r][item] = min(e, found[a + r].get(item, e))
            for a, z in slices(off, SLICE_BYTES):
                for r, item, e in phrases(block, off[a:z + 1] - off[a], data[off[a]:off[z]], head[off[a]:off[z]]):
                    found[a + r][item] = e
            for r, of in found.items():
                ids[r] = sorted({*ids[r], *of})
                least[r] = min(x for x in (*of.values(), least[r]) if x is not None)
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            cols["item_ids"], cols["least_edits"] = pa.array(ids, pa.list_(pa.int64())), pa.array(least, pa.int32())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids and least_edits of every document."""
    return match(docs, benchmark, ["doc_id"]).select(
        "doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "least_edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    plain, back = shield(docs)
    return match(plain, benchmark, plain.columns).where(F.size("item_ids") == 0).select(*back)

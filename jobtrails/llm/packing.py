"""Packing of tokenised documents into sequences by swap-based local search.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens.
Pieces of one length are alike to a packer, so the problem is the histogram of
lengths, at most ``CAPACITY`` numbers for any corpus, and a solution is a list
of bin types (the lengths in a bin, and how many such bins).  Best fit
decreasing makes the first solution.  Local search then exchanges one piece for
one, two for one or one for two, or moves a piece, between underfull bins
wherever that raises the sum of squared fills, for as many bins of a type at
once as there are; the emptiest bins go first and vanish when empty.  It ends
at the least number of bins the tokens allow or when no exchange helps: a type
that has none left is looked at again only if a new type can take from it.

Each piece then needs its rank among the pieces of its length: its number
within its task plus the counts of the tasks before.  Ranks are looked up in
the solution's intervals, so no piece travels further than one narrow join.

Edge cases: a null text is empty; an empty text is the end token alone.
Repeated rows are rows of their own.  An empty table gives no sequences.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrails.llm.common import arrow_schema, batch, materialise

CAPACITY = 1024
END = 2
#: chunks whose ids a worker keeps, some 230 bytes each
MEMO = 1_400_000

Types = dict[tuple[int, ...], int]


# ---------------------------------------------------------------- tokens

class Chunks(dict):
    """Token ids (little-endian 32-bit) of text chunks, by chunk.

    The tokenizer's pattern always begins a new piece at a space that a
    character other than white space follows, so a text cut there has the
    tokens of its chunks.  Chunks of letters, with a mark after them, are single
    pieces that the model takes without the pattern.
    """

    def __init__(self, path: str, memo: int = MEMO):
        super().__init__()
        self.memo = memo
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        plain = ByteLevel(add_prefix_space=False, use_regex=False)
        alphabet = {c: plain.pre_tokenize_str(c)[0][0] for c in map(chr, range(32, 592))}
        self.alphabet = str.maketrans(alphabet)
        self.marks = {c: self._ids(c) for c in ".,;:!?"}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """``chunk`` stands after a space; it must not be empty or begin with white space."""
        if not chunk or chunk[0].isspace():
            raise _Odd
        if len(self) >= self.memo:
            self.clear()
        if chunk[-1] in self.marks and chunk[:-1].isalpha():
            ids = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            ids = self._piece(" " + chunk, chunk)
        self[chunk] = ids
        return ids

    def _piece(self, text: str, word: str) -> bytes:
        if word.isalpha() and max(word) < "ɐ":
            return np.array([t.id for t in self.tokenizer.model.tokenize(text.translate(self.alphabet))], "<u4").tobytes()
        return self._ids(text)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self._ids(text)
        try:
            return self._piece(first, first) + b"".join(map(self.__getitem__, rest))
        except _Odd:  # two spaces together, one at the end, or other white space after one
            return self._ids(text)


class _Odd(Exception):
    """The text can't be cut at its spaces."""


PIECES_DDL = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, memo: int = MEMO) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and part and nth:
    its task and its number among the task's pieces of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, chunks, part = arrow_schema(PIECES_DDL), _chunks(tokenizer, memo), TaskContext.get().partitionId()
        last, seen = np.array([end], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = chunks.encode(text or "") + last
                n = len(ids) // 4
                at = n % capacity or capacity  # only the first piece may be shorter
                cuts = [0, *range(at, n + 1, capacity)]
                rows += [(doc, i, a, z - a, crc32(ids[4 * a:4 * z])) for i, (a, z) in
                         enumerate(zip(cuts, cuts[1:], strict=False))]
            if not rows:
                continue
            doc, piece, start, length, crc = zip(*rows, strict=True)
            length = np.array(length, np.int64)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            yield batch(schema, doc_id=list(doc), piece=list(piece), start=list(start), length=length,
                        ids_crc32=list(crc), part=np.full(len(length), part), nth=nth)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES_DDL)


_LOADED: dict[tuple[str, int], Chunks] = {}


def _chunks(path: str, memo: int = MEMO) -> Chunks:
    """Those of the worker's last tokenizer, kept from task to task."""
    if (path, memo) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, memo] = Chunks(path, memo)
    return _LOADED[path, memo]


# ---------------------------------------------------------------- search

def best_fit(histogram: dict[int, int], capacity: int) -> Types:
    """Best fit decreasing for all pieces of a length at once."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, number]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if open_bins.get(r)), None)
            if room is None:
                room, (lengths, number) = capacity, ((), left)
            else:
                lengths, number = open_bins[room].pop()
            k = room // length  # a bin that takes one stays the tightest for the next
            full = min(number, left // k)
            if full < number and lengths:
                open_bins[room].append([lengths, number - full])
            if full:
                open_bins[room - k * length].append([lengths + (length,) * k, full])
                left -= full * k
            elif left:  # fewer than fill one bin
                if lengths:
                    open_bins[room].pop()
                    if number > 1:
                        open_bins[room].append([lengths, number - 1])
                open_bins[room - left * length].append([lengths + (length,) * left, 1])
                left = 0
    types: Types = defaultdict(int)
    for bins in open_bins.values():
        for lengths, number in bins:
            types[tuple(sorted(lengths, reverse=True))] += number
    return dict(types)


def _groups(lengths: tuple[int, ...]) -> dict[int, tuple[int, ...]]:
    """Sums of one or two pieces of a bin, and the pieces (by distinct lengths,
    of which a bin has some forty at most, however many its pieces)."""
    some = sorted(set(lengths))
    twice = {2 * a: (a, a) for a in some if lengths.count(a) > 1}
    return twice | {a + b: (a, b) for a, b in combinations(some, 2)} | {a: (a,) for a in some}


def _without(lengths: tuple[int, ...], some: tuple[int, ...]) -> tuple[int, ...]:
    left = list(lengths)
    for x in some:
        left.remove(x)
    return tuple(left)


class _Bins:
    """Underfull bin types, and a row for each group of pieces that one of them can
    give or take: sum and number of the pieces (none: 0, 0), fill and place of the type."""

    def __init__(self, types: Types, capacity: int):
        self.capacity, self.names, self.at = capacity, [], {}
        self.fill, self.count, self.done = (np.zeros(0, np.int64) for _ in range(3))
        self.rows = np.zeros((4, 0), np.int64)
        self.full: Types = {}
        for t, n in sorted(types.items()):
            self.add(t, n)

    def add(self, t: tuple[int, ...], n: int) -> int | None:
        """``n`` more bins of a type; its place if it is new."""
        if sum(t) == self.capacity:
            self.full[t] = self.full.get(t, 0) + n
            return None
        if t in self.at:
            i = self.at[t]
            self.count[i] += n
            self.done[i] = 0  # its bins can exchange with each other now
            return None
        i = self.at[t] = len(self.names)
        self.names.append(t)
        self.fill, self.count, self.done = (np.append(x, v) for x, v in (
            (self.fill, sum(t)), (self.count, n), (self.done, 0)))
        new = [(0, 0), *((x, len(p)) for x, p in _groups(t).items())]
        self.rows = np.concatenate([self.rows, [[x for x, _ in new], [k for _, k in new], [sum(t)] * len(new),
                                                [i] * len(new)]], axis=1)
        return i

    def take(self, i: int, n: int) -> None:
        self.count[i] -= n
        if not self.count[i]:
            del self.at[self.names[i]]
            dead = self.count[self.rows[3]] == 0
            if 2 * dead.sum() > len(dead):
                self.rows = self.rows[:, ~dead]

    def _gains(self, given: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """What the exchanges add to the sum of squared fills, those that fill a
        bin before all others; 0: not allowed, or no gain."""
        d, room = given[0] - taken[0], self.capacity - taken[2]
        ok = (d > np.maximum(given[2] - taken[2], 0)) & (d <= room) & (given[1] + taken[1] <= 3) & (given[1] > 0)
        return np.where(ok, d * (taken[2] - given[2] + d) + (d == room) * self.capacity ** 2, 0)

    def best(self, giver: int) -> tuple[int, int, int] | None:
        """Taker and the sums given and taken of the exchange that gains most."""
        takers = self.rows[:, (self.count[self.rows[3]] > 0) & ((self.rows[3] != giver) | (self.count[giver] > 1))]
        most, found = 0, None
        for given in self.rows[:, self.rows[3] == giver].T[1:] if takers.size else ():
            gain = self._gains(given, takers)
            j = int(gain.argmax())
            if gain[j] > most:
                most, found = int(gain[j]), (int(takers[3, j]), int(given[0]), int(takers[0, j]))
        return found

    def wake(self, taker: int) -> None:
        """Types that were done are open again if the new type ``taker`` can take from them."""
        givers = self.rows[:, (self.done[self.rows[3]] > 0) & (self.count[self.rows[3]] > 0)]
        for taken in self.rows[:, self.rows[3] == taker].T:
            self.done[givers[3, self._gains(givers, taken) > 0]] = 0

    def types(self) -> Types:
        return self.full | {t: int(self.count[i]) for t, i in self.at.items()}


def local_search(types: Types, capacity: int) -> Types:
    """Exchanges between underfull bins; see the module's text."""
    least = -(-sum(sum(t) * n for t, n in types.items()) // capacity)
    number, bins = sum(types.values()), _Bins(types, capacity)
    while number > least:
        ready = np.flatnonzero((bins.count > 0) & (bins.done == 0))
        if not len(ready):
            break
        giver = int(ready[bins.fill[ready].argmin()])  # the emptiest
        found = bins.best(giver)
        if found is None:
            bins.done[giver] = 1
            continue
        taker, x, y = found
        a, b = bins.names[giver], bins.names[taker]
        given, taken = _groups(a)[x], _groups(b)[y] if y else ()
        n = int(bins.count[giver] // 2 if giver == taker else min(bins.count[giver], bins.count[taker]))
        bins.take(giver, n)
        bins.take(taker, n)
        new = [tuple(sorted(t, reverse=True)) for t in (_without(a, given) + taken, _without(b, taken) + given)]
        number -= n * new.count(())
        for i in [bins.add(t, n) for t in new if t]:
            if i is not None:
                bins.wake(i)
    return bins.types()


# ---------------------------------------------------------------- placing

class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, types: Types):
        cursor: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for lengths, number in sorted(types.items()):
            offset = 0
            for x in lengths:
                rows.append((x << 40 | cursor[x], first, offset))
                cursor[x] += number
                offset += x
            first += number
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.key, self.first, self.offset = table.T.copy()

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 40 | rank, "right") - 1
        return self.first[at] + rank - (self.key[at] & ((1 << 40) - 1)), self.offset[at]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, memo: int = MEMO) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every
    piece.  ``memo`` bounds what a worker keeps of the tokenizer's results."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity, end, memo), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {x["length"]: x["n"] for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(local_search(best_fit(histogram, capacity), capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for b in batches:
            sequence, offset = places.value.find(b["length"].to_numpy(), b["rank"].to_numpy())
            cols = {n: b[n] for n in schema.names[:5]}
            yield batch(schema, **cols, sequence_id=sequence, offset=offset)

    return ranked.mapInArrow(run, ddl)

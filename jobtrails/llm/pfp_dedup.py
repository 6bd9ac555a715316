"""Removal of repeated byte strings by prefix-free parsing.

Every string of ``length`` bytes that starts at two places of the corpus is
found, and each byte that such a string covers is removed.

*Parse.*  A rolling hash over eight bytes picks triggers: a start's trigger is
the place of the least hash among the first ``REACH`` places of its string, so
equal strings have equal triggers wherever they stand, and no string goes
without one.  Runs of starts with one trigger are the phrases of the parse.

*Dictionary and parse order.*  All phrases are put in one order by what follows
their trigger (the bytes that every string of the phrase holds) and then by the
phrase with its whole continuation; the order uses fingerprints, since only
equal neighbours matter, not which is less.  Neighbours with an equal
continuation repeat with all their starts.  Neighbours that share only what
follows the trigger are phrases at the rim of a repeat: they are cut into
blocks of ``BLOCK`` starts, which are put in order likewise, and what is at a
rim again is settled start by start.  Whatever stands alone in an order can't
hold a repeated string.  In repetitive text nearly everything is settled by
phrases, a row for some 60 bytes.

Edge cases: a null text is empty; texts shorter than ``length`` have nothing
to remove.  Equal texts, repeated rows included, remove each other wholly if
they are long enough.  Matches never cross documents.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtrails.llm.common import arrow_schema, batch, materialise, shield, slices, utf8

LENGTH = 200
GRAM = 8
#: places among which a string's trigger is chosen; a power of two
REACH = 128
SLICE_BYTES = 1 << 20
#: starts of a block; the string of each holds the same length - BLOCK + 1 bytes
BLOCK = 16
_SIZE = (1 << 17) - 1
FULL, RIM, WITNESS = 0, 1, 2


def text_key(text: Column) -> tuple[Column, Column]:
    """What names a text: a 64-bit hash and 17 bits of its size."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("h"), (F.octet_length(text).bitwiseAND(F.lit(_SIZE))).cast("bigint").alias("size")


def triggers(data: np.ndarray) -> np.ndarray:
    """Place of the trigger for each start that has REACH grams after it."""
    n = len(data) - GRAM + 1
    if n < REACH:
        return np.zeros(0, np.int64)
    g = np.empty(n, np.uint64)
    raw = data.tobytes()
    for k in range(GRAM):
        g[k::GRAM] = np.frombuffer(raw, "<u8", len(range(k, n, GRAM)), k)
    g *= np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # the first of equal hashes
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(off: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, trigger) of every phrase."""
    n = np.maximum(np.diff(off) - length + 1, 0)
    total = int(n.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return empty, empty, empty, empty
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[:-1], n)
    at = triggers(data)[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], total) - 1
    return row[first], start[first], start[last], at[first]


#: what is known of a row: it repeats; it stands beside others of its key; it is settled
#: (a repeat that a row of its own stands for); it only stands for others of its key
REPEATS, BESIDE, SETTLED, GHOST = 1, 2, 4, 8
#: continuations of a key in one batch from which its rows are dealt apart
HOT = 64
PHRASES_DDL = "deal bigint, k bigint, ctx bigint, h bigint, pos bigint, mark int"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _deal(hot_from: int, k: np.ndarray, ctx: np.ndarray, h: np.ndarray, pos: np.ndarray, mark: np.ndarray
          ) -> dict[str, np.ndarray]:
    """Rows of a batch before the shuffle, so that no key is hot in it.

    Equal continuations of the batch repeat: one row goes on for them, the
    others are settled and dealt anywhere.  A key with many continuations is
    known to stand beside others: its rows are dealt by the continuation too,
    and a ghost stands for them among the rows of that key from elsewhere.
    """
    order = np.lexsort((ctx, k))
    k, ctx, h, pos, mark = (x[order] for x in (k, ctx, h, pos, mark))
    new_k = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_k | np.concatenate([[True], ctx[1:] != ctx[:-1]])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(k))) > 1
    mark[first[many]] |= REPEATS
    number = np.cumsum(new_k) - 1
    hot = (np.bincount(number[first]) >= hot_from)[number] & new
    mark[hot] |= BESIDE
    mark[~new] = SETTLED
    deal = np.where(hot, _mix(k, ctx), k)
    apart = _mix(h, pos)
    deal, k, ctx = (np.where(new, x, apart) for x in (deal, k, ctx))
    ghost = k[hot & new_k]
    n = len(ghost)
    return {"deal": np.append(deal, ghost), "k": np.append(k, ghost), "ctx": np.append(ctx, _mix(ghost, ghost)),
            "h": np.append(h, np.zeros(n, np.int64)), "pos": np.append(pos, np.zeros(n, np.int64)),
            "mark": np.append(mark, np.full(n, GHOST)).astype(np.int32)}


def _parse(length: int, hot: int):
    """pos: first start << 32 | starts - 1 << 24 | way to the trigger << 17 | size."""
    shared = length - REACH + 1  # bytes after the trigger that all strings of a phrase hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, digest = arrow_schema(PHRASES_DDL), xxhash.xxh3_64_intdigest
        for b in batches:
            # equal texts of a batch are parsed once
            names = b["h"].to_numpy()
            _, one, copies = np.unique(names, return_index=True, return_counts=True)
            off, data = utf8(b["text"].take(pa.array(one)))
            parts = []
            for a, z in slices(off, SLICE_BYTES):
                o, d = off[a:z + 1] - off[a], data[off[a]:off[z]]
                row, i1, i2, at = phrases(o, d, length)
                raw = d.tobytes()
                k = np.array([digest(raw[x:x + shared]) for x in at.tolist()], np.uint64).view(np.int64)
                ctx = np.array([digest(raw[x:y + length]) for x, y in zip(i1.tolist(), i2.tolist(), strict=True)],
                               np.uint64).view(np.int64)
                size = np.diff(o)[row] & _SIZE
                pos = ((i1 - o[row]) << 32) | ((i2 - i1) << 24) | ((at - i1) << 17) | size
                parts.append((k, ctx, names[one[a:z]][row], pos, np.where(copies[a:z][row] > 1, REPEATS, 0)))
            if sum(len(x[0]) for x in parts):
                yield batch(schema, **_deal(hot, *map(np.concatenate, zip(*parts, strict=True))))

    return run


def _neighbours(columns: list[str], ddl: str, judge):
    """Run ``judge(rows, lo, hi)`` over sorted batches so that each row is seen
    once with the rows before and after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, seen = arrow_schema(ddl), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = {c: b[c].to_numpy(zero_copy_only=False) for c in columns}
            rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in columns}
            last = len(rows[columns[0]]) - 1  # waits for its neighbour
            if last > seen:
                yield batch(schema, **judge(rows, seen, last))
            keep = max(last - 1, 0)
            held, seen = {c: x[keep:] for c, x in rows.items()}, last - keep
        if held is not None:
            yield batch(schema, **judge(held, seen, len(held[columns[0]])))

    return run


def _same(rows: dict[str, np.ndarray], cols: list[str], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows lo..hi: whether the one before and the one after agree in ``cols``."""
    n = len(rows[cols[0]])
    eq = np.ones(n + 1, bool)  # eq[i]: rows i - 1 and i agree
    for c in cols:
        eq[1:n] &= rows[c][1:] == rows[c][:-1]
    eq[0] = eq[n] = False
    return eq[lo:hi], eq[lo + 1:hi + 1]


def _standing(rows: dict[str, np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that repeat wholly; rows that share only their key; rows that
    repeat and stand beside others of their key (one of equal ones at least)."""
    mark = rows["mark"][lo:hi]
    key_before, key_after = _same(rows, ["k"], lo, hi)
    before, after = _same(rows, ["k", "ctx"], lo, hi)
    full = before | after | (mark & (REPEATS | SETTLED) > 0)
    other = (key_before & ~before) | (key_after & ~after) | ((mark & BESIDE > 0) & ~before)
    other &= mark & SETTLED == 0
    real = mark & GHOST == 0
    return full & real, other & ~full & real, other & full & real


def _judge_phrases(rows: dict[str, np.ndarray], lo: int, hi: int) -> dict[str, np.ndarray]:
    some = [np.flatnonzero(x) for x in _standing(rows, lo, hi)]
    kind = np.repeat(np.array([FULL, RIM, WITNESS], np.int32), [len(x) for x in some])
    at = np.concatenate(some) + lo
    return {"h": rows["h"][at], "pos": rows["pos"][at], "kind": kind}


BLOCKS_DDL = "k bigint, ctx bigint, h bigint, pos bigint, kind int, mark int, rim binary"


def _cut_blocks(length: int):
    """The blocks of the phrases listed for a text.  A block holds the starts
    whose way to the trigger has the same quotient by BLOCK; ``rim`` is the
    number of its bytes before and the bytes before and after what all have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, digest = arrow_schema(BLOCKS_DDL), xxhash.xxh3_64_intdigest
        for b in batches:
            off, data = utf8(b["text"])
            rows = []
            for i, (h, size, listed) in enumerate(zip(b["h"].to_pylist(), b["size"].to_pylist(),
                                                      b["listed"].to_pylist(), strict=True)):
                raw = data[off[i]:off[i + 1]].tobytes()
                for x in listed:
                    first, span, way, kind = x >> 32, (x >> 24) & 127, (x >> 17) & 127, x & 3
                    at = first + way
                    for q in range((way - span) // BLOCK, way // BLOCK + 1):
                        high, low = min(way, q * BLOCK + BLOCK - 1), max(way - span, q * BLOCK)
                        a, z, core = at - high, at - low, at - q * BLOCK
                        end = core + length - BLOCK + 1
                        rows.append((digest(raw[core:end], q), digest(raw[a:z + length], high << 8 | low), h,
                                     a << 32 | (z - a) << 24 | size, kind,
                                     bytes([core - a]) + raw[a:core] + raw[end:z + length]))
            if rows:
                k, ctx, h, pos, kind, rim = zip(*rows, strict=True)
                k, ctx = np.array(k, np.uint64).view(np.int64), np.array(ctx, np.uint64).view(np.int64)
                h, pos, kind = np.array(h, np.int64), np.array(pos, np.int64), np.array(kind, np.int32)
                # equal blocks of a batch repeat: a witness stands for them, and those asked for are settled
                _, first, group, n = np.unique(np.stack([k, ctx]), axis=1, return_index=True, return_inverse=True,
                                               return_counts=True)
                many = np.ravel(n[np.ravel(group)]) > 1
                stand, done = first[n > 1], np.flatnonzero(many & (kind == RIM))
                alone = np.flatnonzero(~many)
                at = np.concatenate([alone, stand, done])
                apart = _mix(h[done], pos[done])
                yield batch(schema, k=np.concatenate([k[alone], k[stand], apart]),
                            ctx=np.concatenate([ctx[alone], ctx[stand], apart]), h=h[at], pos=pos[at],
                            kind=np.concatenate([kind[alone], np.full(len(stand), WITNESS), kind[done]]).astype(np.int32),
                            mark=np.repeat(np.array([0, REPEATS, SETTLED], np.int32), [len(alone), len(stand), len(done)]),
                            rim=[rim[i] for i in at])

    return run


STARTS_DDL = "k bigint, w bigint, h bigint, pos bigint, kind int"


def _judge_blocks(rows: dict[str, np.ndarray], lo: int, hi: int) -> dict[str, np.ndarray]:
    """Repeated blocks as they are, and the single starts of blocks at a rim
    (k and w name the string of a start)."""
    full, rim, witness = _standing(rows, lo, hi)
    k, h, pos, kind = (rows[c][lo:hi] for c in ("k", "h", "pos", "kind"))
    done = np.flatnonzero(full & (kind == RIM))
    out: list[list] = [k[done].tolist(), pos[done].tolist(), h[done].tolist(), pos[done].tolist(), [FULL] * len(done)]
    digest = xxhash.xxh3_64_intdigest
    for i in np.flatnonzero(rim | witness).tolist():
        around = rows["rim"][lo + i]
        left, first, size = around[0], int(pos[i]) >> 32, int(pos[i]) & _SIZE
        role = RIM if rim[i] and kind[i] == RIM else WITNESS
        for j in range((int(pos[i]) >> 24 & 127) + 1):  # the j-th start has left - j bytes before the core
            string = around[1 + j:1 + j + BLOCK - 1]  # what of it is before and after the core
            out[0].append(int(k[i]))
            out[1].append(np.uint64(digest(string, left - j)).astype(np.int64).item())
            out[2].append(int(h[i]))
            out[3].append((first + j) << 32 | size)
            out[4].append(role)
    return dict(zip(("k", "w", "h", "pos", "kind"), out, strict=True))


def _judge_starts(rows: dict[str, np.ndarray], lo: int, hi: int) -> dict[str, np.ndarray]:
    before, after = _same(rows, ["k", "w"], lo, hi)
    kind = rows["kind"][lo:hi]
    some = np.flatnonzero((kind == FULL) | ((before | after) & (kind == RIM))) + lo
    return {"h": rows["h"][some], "pos": rows["pos"][some]}


def _with_starts(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with the columns __h, __size (see text_key) and __starts: runs
    (first << 8 | number - 1) of the places at which repeated strings start,
    or null."""
    if length < REACH + GRAM:
        raise ValueError(f"length must be {REACH + GRAM} at least")
    h, size = text_key(F.col("text"))
    keyed = docs.withColumns({"__h": h, "__size": size})
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), h).where(F.octet_length("text") >= length)
    small = "h bigint, pos bigint, kind int"
    found = texts.mapInArrow(_parse(length, HOT), PHRASES_DDL).repartition("deal").sortWithinPartitions("k", "ctx").mapInArrow(
        _neighbours(["k", "ctx", "h", "pos", "mark"], small, _judge_phrases), small)
    # the same phrase of equal texts, dealt apart, may come twice as a rim: it repeats, and stands for others
    kinds = F.when((F.col("kind") == RIM) & (F.col("n") > 1), F.array(F.lit(FULL), F.lit(WITNESS))
                   ).otherwise(F.array("kind"))
    found = materialise(found.groupBy("h", "pos", "kind").agg(F.count(F.lit(1)).alias("n")).select(
        "h", "pos", F.explode(kinds).alias("kind")), "repeats")
    of_text = [F.col("h").alias("__h"), F.col("pos").bitwiseAND(F.lit(_SIZE)).alias("__size")]

    # the place without the size leaves room for the kind
    place = F.col("pos") - F.col("pos").bitwiseAND(F.lit(_SIZE))
    rims = found.where(F.col("kind") != FULL).groupBy(*of_text).agg(F.collect_list(place + F.col("kind")).alias("listed"))
    # all columns of ``keyed`` go in, so that this and the last join are fed by one and the same exchange
    blocks = keyed.join(rims, ["__h", "__size"]).dropDuplicates(["__h", "__size"]).withColumnsRenamed(
        {"__h": "h", "__size": "size"}).mapInArrow(_cut_blocks(length), BLOCKS_DDL)
    starts = blocks.repartition("k").sortWithinPartitions("k", "ctx").mapInArrow(
        _neighbours(["k", "ctx", "h", "pos", "kind", "mark", "rim"], STARTS_DDL, _judge_blocks), STARTS_DDL)
    starts = starts.repartition("k", "w").sortWithinPartitions("k", "w").mapInArrow(
        _neighbours(["k", "w", "h", "pos", "kind"], "h bigint, pos bigint", _judge_starts), "h bigint, pos bigint")
    span = F.shiftright("pos", 24).bitwiseAND(F.lit(127))
    run = (F.shiftright("pos", 32) * 256 + span).alias("run")
    starts = found.where(F.col("kind") == FULL).select(*of_text, run).union(starts.select(*of_text, run)).groupBy(
        "__h", "__size").agg(F.collect_list("run").alias("__starts"))
    return keyed.join(starts, ["__h", "__size"], "left")


def removed_runs(starts: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings at ``starts`` cover."""
    if not starts:
        return []
    x = np.sort(np.array(starts, np.int64))
    a, z = x >> 8, (x >> 8) + (x & 255) + length
    z = np.maximum.accumulate(z)
    first = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    return list(zip(a[first].tolist(), z[np.append(first[1:], len(x)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (from << 32 | to) of every document."""
    ddl = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"
    src = _with_starts(docs.select("doc_id", "text"), length).select("doc_id", "text", "__starts")
    out = StructType(src.select("doc_id").schema.fields + StructType.fromDDL(ddl).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for b in batches:
            off, data = utf8(b["text"])
            rows = []
            for i, starts in enumerate(b["__starts"].to_pylist()):
                text = data[off[i]:off[i + 1]].tobytes()
                runs = removed_runs(starts, length)
                kept, at = hashlib.sha256(), 0
                for a, z in runs:
                    kept.update(text[at:a])
                    at = z
                kept.update(text[at:])
                rows.append((len(text), sum(z - a for a, z in runs), len(runs), kept.hexdigest(),
                             [a << 32 | z for a, z in runs]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            found = batch(schema, **dict(zip(schema.names, map(list, cols), strict=True)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *found.columns], names=["doc_id", *schema.names])

    return src.mapInArrow(run, out)


def cut_text(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without the runs, each narrowed to whole characters."""
    kept, at = [], 0
    for a, z in runs:
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        kept.append(text[at:a])
        at = z
    return b"".join([*kept, text[at:]])


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated runs cut out of text (a column n_chars follows
    it).  Texts without repeats stay as they are."""
    plain, back = shield(docs)
    src = _with_starts(plain, length).drop("__h", "__size")
    out = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            for i, starts in enumerate(b["__starts"].to_pylist()):
                if starts:
                    texts[i] = cut_text(texts[i].encode(), removed_runs(starts, length)).decode()
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names) if n != "__starts"}
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([cols[n] for n in out.names], names=out.names)

    kept = src.mapInArrow(run, out).select(*back)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.length("text").cast(kind))
    return kept

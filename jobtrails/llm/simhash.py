"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into m segments.  If two differ in r bits at most, then by
the pigeonhole principle some early segment differs in r // m bits at most, or
a later one in fewer (see ``radii``).  So each distinct fingerprint is filed
under its segment values, the Hamming ball of every value is enumerated (one
direction of a pair suffices: towards larger values), equal values meet in one
shuffle, and complete distances are verified there.  A bucket returns a
spanning forest of its verified links, not all pairs, so that a dense group
costs rows in proportion to its members and no link between components is lost.

m follows the number of distinct fingerprints so that a bucket holds a few by
chance; every m gives the same, exact links.

Edge cases: a null or empty text, or one without words, has fingerprint zero
and links like any other.  Fewer words than a shingle: the whole sequence is
one.  Repeated rows share a fingerprint.  A null id counts as larger than any
other; a group with null ids only has a null component.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobtrails.llm.common import arrow_schema, batch, materialise, shield
from jobtrails.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: expected members of a bucket by chance, and members above which a bucket is walked instead of paired
OCCUPANCY = 4
WALK = 48
PAIRS = 2_000_000
_ONES = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # ASCII case and ASCII white space only, as bytes
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)], ">u8")
    ones = sum(np.unpackbits(h[i:i + _ONES].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
               for i in range(0, n, _ONES))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed bigint."""
    src = docs.select(*keep, F.col("text").alias("__text"))
    out = StructType([*docs.select(*keep).schema.fields, StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.cast(b["__text"].fill_null("").cast(pa.string()), pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            rest = [i for i, name in enumerate(b.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(fp)],
                                             names=[*(b.schema.names[i] for i in rest), "fp"])

    return src.mapInArrow(run, out)


def radii(m: int, r: int) -> list[int]:
    """Ball radius of each of m segments: r = m q + a allows q for the first
    a + 1 and q - 1 for the others (all beyond sums to r + 1 bits); -1: none."""
    q, a = divmod(r, m)
    return [q] * (a + 1) + [q - 1] * (m - a - 1)


def segment_plan(n: int, r: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of the segments that are searched."""
    m = next((m for m in range(r + 1, 1, -1) if n <= OCCUPANCY << (64 // m)), 2)
    edge = [64 * i // m for i in range(m + 1)]
    return [(edge[i], edge[i + 1] - edge[i], radius) for i, radius in enumerate(radii(m, r)) if radius >= 0]


def _probes(fps: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """key (segment and value), probe (0: filed there, 1: looks there), fp."""
    ddl = "key bigint, probe int, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for b in batches:
            fp = b["fp"].to_numpy()
            for s, (shift, bits, radius) in enumerate(plan):
                value = (fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                for size in range(radius + 1):
                    for flips in combinations(range(bits), size):
                        mask = np.uint64(sum(1 << f for f in flips))
                        some = (value ^ mask) >= value  # the smaller of two values looks for the larger
                        key = ((value[some] ^ mask) | np.uint64(s << 40)).view(np.int64)
                        yield batch(schema, key=key, probe=np.full(len(key), int(size > 0), np.int32), fp=fp[some])

    return fps.select("fp").mapInArrow(run, ddl)


def _walk(filed: np.ndarray, fps: np.ndarray, r: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of the ``filed`` members of a bucket with
    all its members ``fps``: each member is found once, and only what isn't
    found yet is compared again."""
    rest, found = np.unique(fps), []
    for seed in np.unique(filed):
        at = np.searchsorted(rest, seed)
        if at == len(rest) or rest[at] != seed:
            continue
        front, rest = [seed], np.delete(rest, at)
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= r
            if near.any():
                found += [(int(x), int(y)) for y in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
    return found


class _Union(dict):
    def root(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            self[x] = self.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _bucket_links(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, r: int) -> list[tuple[int, int]]:
    """Links in whole buckets, sorted by key and probe."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    filed = np.add.reduceat((probe == 0).astype(np.int64), start)
    large = (filed > WALK) | (filed * size > PAIRS)
    links = [x for i in np.flatnonzero(large & (size > 1))
             for x in _walk(fp[start[i]:start[i] + filed[i]], fp[start[i]:start[i] + size[i]], r)]
    some = np.flatnonzero(~large & (filed > 0) & (size > 1))
    pairs = filed[some] * size[some]  # each filed member with all of its bucket
    done, union = 0, _Union()
    ends = np.cumsum(pairs)
    while done < len(some):
        last = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        at, n = some[done:last], pairs[done:last]
        run = np.repeat(np.arange(len(at)), n)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = fp[start[at][run] + i // size[at][run]]
        y = fp[start[at][run] + i % size[at][run]]
        near = (x != y) & (np.bitwise_count(x ^ y) <= r)
        links += [(a, b) for a, b in zip(x[near].tolist(), y[near].tolist(), strict=True) if union.join(a, b)]
        done = last
    return links


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (column fp) at most
    ``max_bits`` apart into their components."""
    plan = segment_plan(fps.count(), max_bits)
    ddl = "a bigint, b bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = arrow_schema(ddl), None
        for b in _then_none(batches):
            cols = held
            if b is not None:
                new = [b["key"].to_numpy(), b["probe"].to_numpy(), b["fp"].to_numpy().view(np.uint64)]
                cols = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            # the last bucket may go on in the next batch
            cut = len(cols[0]) if b is None else int(np.searchsorted(cols[0], cols[0][-1], "left"))
            held = [x[cut:] for x in cols]
            if cut:
                found = np.array(_bucket_links(*(x[:cut] for x in cols), max_bits), np.uint64).reshape(-1, 2)
                yield batch(schema, a=found[:, 0].view(np.int64), b=found[:, 1].view(np.int64))

    return _probes(fps, plan).repartition("key").sortWithinPartitions("key", "probe").mapInArrow(run, ddl)


def _then_none(batches):
    yield from batches
    yield None


def group_near_copies(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``marked`` (doc_id, fp and more columns) with component_id, the smallest
    doc_id among linked fingerprints, and root, a fingerprint that names the
    component."""
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    found = components(links(fps, max_bits)).join(fps, F.col("node") == F.col("fp")).select("fp", "root", "low")
    lowest = found.groupBy("root").agg(F.min("low").alias("lowest"))
    found = found.join(lowest, "root").select("fp", "root", "lowest")
    by_fp = fps.join(found, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    return marked.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    marked = materialise(fingerprints(docs, ["doc_id"], shingle), "simhash")
    return group_near_copies(marked, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest
    doc_id (nulls last, then by text hash); of equal rows one stays."""
    plain, back = shield(docs)
    key = plain.withColumns({"th": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "doc_id": F.col("__in_doc_id")})
    marked = materialise(fingerprints(key, ["doc_id", "th"], shingle), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    stay = group_near_copies(marked, max_bits).groupBy("root").agg(F.min(rank).alias("k")).select(
        F.col("k.doc_id").alias("stay_id"), F.col("k.th").alias("stay_th"))
    kept = key.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("th") == F.col("stay_th")), "left_semi")
    if marked.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        one = Window.partitionBy("doc_id", "th").orderBy(F.lit(0))
        kept = kept.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return kept.select(*back)

"""URL allow and block lists as a trie over reversed host labels and path
segments; the longest matching entry wins.

A rule ``host/path`` fits a host and all its subdomains where the url's path
starts with ``/path``.  "Longest" compares host labels first, then path
characters; of an allow and a block entry of equal length the block wins.

The trie is broadcast while the list is under ``MAX_TRIE_BYTES``; longer lists
are matched by joining each url's host suffixes and path prefixes with the rule
table, which gives the same result.

Edge cases: a null url or one without ``://`` has empty host and path and fits
no rule.  A url without a path has the empty path, which starts with no rule's
path.  Repeated pages are each judged.  No rules or no pages: default verdicts
or an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrails.llm.common import arrow_schema, batch

MAX_TRIE_BYTES = 16 << 20


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts: a host label leads down; None holds the path node.
    In a path node a whole segment leads down, and ``""`` keys hold the
    unfinished last segments of rules that end here, with their verdicts."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("/", segment), {})
            if node.get(last, ("", ""))[1] != "block":
                node[last] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        if not path.startswith("/"):
            return None
        best, node = None, self.root
        segments = path[1:].split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._in_path(node[None], segments) or best
        return best

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            for end in range(len(segment) + 1):  # rules that end within this segment
                best = node.get(segment[:end]) or best
            # a segment is whole only if a slash follows it
            node = node.get(("/", segment)) if i + 1 < len(segments) else None
            if node is None:
                break
        return best


def _by_trie(pages: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    out = "page_id bigint, host string, path string, rule string, verdict string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, trie = arrow_schema(out), shared.value
        for b in batches:
            found = [trie.find(h, p) or (None, default)
                     for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            yield batch(schema, page_id=b["page_id"], host=b["host"], path=b["path"],
                        rule=[x[0] for x in found], verdict=[x[1] for x in found])

    return pages.mapInArrow(judge, out)


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Equi-join of every (host suffix, path prefix) with the rule table.
    Only prefixes as long as some rule's path are made."""
    r = rules.select(F.lower(F.substring_index("rule", "/", 1)).alias("rh"), "rule", "verdict",
                     F.expr("substr(rule, instr(rule, '/'))").alias("rp"))
    r = r.groupBy("rh", "rp").agg(F.max_by("rule", "verdict").alias("rule"), F.max("verdict").alias("verdict"))
    # a number for each different length of a rule's path
    lengths = F.lit([x[0] for x in r.select(F.length("rp")).distinct().collect()]).cast("array<int>")
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    cand = urls.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth")).select(
        "host", "path", "depth", F.array_join(F.slice(labels, -F.col("depth"), F.col("depth")), ".").alias("rh"),
        F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
    cand = cand.withColumn("rp", F.expr("substr(path, 1, n)"))
    hits = cand.join(r, ["rh", "rp"]).groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct("depth", "n")).alias("hit"))
    return pages.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow",
               max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """``rules``: (host/path, "allow" or "block") pairs, or a table of the
    columns rule and verdict; one without a slash, or null, fits no url.
    Returns page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    url = F.col("url")
    urls = pages.select(F.col("page_id").cast("bigint"), url_host(url).alias("host"), url_path(url).alias("path"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "rule string, verdict string")
    # a rule without a slash names a host and no path: it fits none, like a null one
    rules = rules.where(F.col("rule").contains("/") & F.col("verdict").isNotNull())
    size = rules.agg(F.sum(F.octet_length("rule") + 64)).first()[0] or 0
    if size <= max_trie_bytes:
        return _by_trie(urls, [tuple(x) for x in rules.select("rule", "verdict").collect()], default)
    return _by_join(urls, rules, default)

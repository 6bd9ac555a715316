"""Tags and values of XML records as the data have them.

Nothing is declared: every record is cut from the text at its closing tag (the
text source splits plain files at it, so records of one file are spread over
tasks) and parsed by itself, so that a malformed record costs that record only.
A task counts what it walks over before anything is shuffled.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "path string, parent string, attr string, value string, n bigint"
_SCHEMA = pa.schema([(c, pa.string()) for c in ("path", "parent", "attr", "value")] + [("n", pa.int64())])


def records(chunk: str, tag: str) -> Iterator[tuple[str, ET.Element | None]]:
    """(text, tree) of the records of a chunk that a closing tag ended; no tree
    if the record can't be parsed.  What stands before the first opening tag is
    no record; a record that isn't closed before the next opens is a bad one."""
    starts = [m.start() for m in re.finditer(rf"<{re.escape(tag)}(?=[\s>])", chunk)]
    for a, b in zip(starts, [*starts[1:], None]):
        text = chunk[a:b] + f"</{tag}>" * (b is None)
        try:
            yield text, ET.fromstring(text)
        except ET.ParseError:
            yield text, None


@dataclass(slots=True)
class Tag:
    """The elements of one path: their number, and how often which (attr,
    value) occurs in them."""

    path: str
    parent: str | None
    n: int = 0
    values: dict[tuple[str, str | None], int] = field(default_factory=lambda: defaultdict(int))
    tags: dict[str, Tag] = field(default_factory=dict)  # of the children

    def rows(self) -> Iterator[tuple[str, str | None, str | None, str | None, int]]:
        """(path, parent, attr, value, n) of this path and those below; no attr: the elements themselves."""
        yield self.path, self.parent, None, None, self.n
        for (attr, value), n in self.values.items():
            yield self.path, self.parent, attr, value, n
        for tag in self.tags.values():
            yield from tag.rows()


def add(root: ET.Element, tags: dict[str, Tag], values: bool = True) -> None:
    """Counts every element of a record, and in it each child, whose value is
    its text, or the number of its own children as ``<tag>.<first child>_count``."""
    top = tags.get(root.tag)
    if top is None:
        top = tags[root.tag] = Tag(root.tag, None)
    todo = [(root, top)]
    while todo:
        e, at = todo.pop()
        at.n += 1
        below, found = at.tags, at.values
        for child in e:
            name = child.tag
            tag = below.get(name)
            if tag is None:
                tag = below[name] = Tag(f"{at.path}/{name}", at.path)
            if len(child):
                if values:
                    found[f"{name}.{child[0].tag}_count", str(len(child))] += 1
                todo.append((child, tag))
            else:
                if values:
                    found[name, child.text] += 1
                tag.n += 1


def _chunks(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    return spark.read.text(paths, lineSep=f"</{tag}>")


def tag_counts(spark: SparkSession, paths: str | list[str], tag: str = "resume", values: bool = True) -> DataFrame:
    """path, parent, attr, value, n over all well-formed records; an element's
    own rows have no attr (without ``values`` there are no others).  The same
    key may come from several tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Tag] = {}
            for chunk in b["value"].to_pylist():
                for _, tree in records(chunk, tag):
                    if tree is not None:
                        add(tree, found, values)
            cols = list(zip(*(row for top in found.values() for row in top.rows()))) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    return _chunks(spark, paths, tag).mapInArrow(run, TAGS)


def bad_records(spark: SparkSession, paths: str | list[str], tag: str = "resume") -> DataFrame:
    """Text of every record that isn't well-formed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [text for chunk in b["value"].to_pylist() for text, tree in records(chunk, tag) if tree is None]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["record"])

    return _chunks(spark, paths, tag).mapInArrow(run, "record string")


def schema_paths(counts: DataFrame) -> DataFrame:
    """A5: every element path below the root, with its parent."""
    return counts.where(F.col("attr").isNull() & F.col("parent").isNotNull()).select("path", "parent").distinct()


def attr_rows(counts: DataFrame) -> DataFrame:
    """Element, attr, value, n, for the histograms of elements."""
    return counts.select(F.col("path").alias("element"), "attr", "value", "n")

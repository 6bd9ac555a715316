"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrails.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the links
    (columns a and b, bigint).

    Each round hangs every node's larger neighbours on its smallest one and
    then its smaller neighbours on the smallest of them; the edges end as stars
    around the roots after a number of rounds logarithmic in the component size.
    The edges of a round are written to the checkpoint folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
                        "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(a.alias("node"), b.alias("root")).union(
                edges.select(b.alias("node"), b.alias("root"))).distinct()
        before = state
        both = edges.union(edges.select(b, a))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
        edges = materialise(small.distinct(), "links")

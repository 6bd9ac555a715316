"""Sequence files and sampler traces.

* JSON lines: one record per history, the ordered stints with their topic
  vector; dates as ``yyyyMMdd`` text.
* Load limits: drop short histories, then keep histories in key order while
  the running entry count *before* each is within the budget.  The running
  sum is taken over at most ``max_entries`` histories (each holds >= 1
  entry), picked by a bounded top-k, so no window spans the whole table.
* Trace store: one Parquet table per model array and commit, partitioned by
  ``iter``, and a list of commits that says which of them count.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrails.session import shuffles_freed

DATE_FMT = "yyyyMMdd"


def write_sequences_jsonl(stints: DataFrame, path: str, seq: str = "person_id", pos: str = "seq_pos",
                          start: str = "start_dt", end: str = "end_dt", company: str = "company",
                          desc: str = "description", vector: str | None = None) -> None:
    """A6 (write): one JSON record per history: ``[[stint, vector], ...]``
    where a stint is (yyyyMMdd, yyyyMMdd, company, description); gzipped."""
    stint = F.struct(F.date_format(F.col(start), DATE_FMT).alias("start"),
                     F.date_format(F.col(end), DATE_FMT).alias("end"),
                     F.col(company).alias("company"), F.col(desc).alias("desc"))
    vec = F.col(vector) if vector else F.array().cast("array<double>")
    recs = (stints.groupBy(seq)
                  .agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), stint.alias("stint"),
                                                            vec.alias("topics")))).alias("jobs"))
                  .select(seq, F.col("jobs")))
    with shuffles_freed(stints.sparkSession):
        recs.write.mode("overwrite").option("compression", "gzip").json(path)


JSONL_SCHEMA = T.StructType([
    T.StructField("person_id", T.LongType()),
    T.StructField("jobs", T.ArrayType(T.StructType([
        T.StructField("pos", T.LongType()),
        T.StructField("stint", T.StructType([T.StructField(n, T.StringType())
                                             for n in ("start", "end", "company", "desc")])),
        T.StructField("topics", T.ArrayType(T.DoubleType()))]))),
])


def read_sequences_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A6 (read): back to long form (person_id, seq_pos, dates, company, desc, topics)."""
    d = spark.read.schema(JSONL_SCHEMA).json(path)
    x = d.select("person_id", F.posexplode("jobs").alias("i", "j"))
    return x.select("person_id", (F.col("i") + 1).cast("bigint").alias("seq_pos"),
                    F.to_date(F.col("j.stint.start"), DATE_FMT).alias("start_dt"),
                    F.to_date(F.col("j.stint.end"), DATE_FMT).alias("end_dt"),
                    F.col("j.stint.company").alias("company"), F.col("j.stint.desc").alias("description"),
                    F.col("j.topics").alias("topics"))


def load_limit(lengths: DataFrame, seq: str, n: str = "n", min_len: int = 1,
               max_entries: int | None = None) -> DataFrame:
    """Histories of at least ``min_len`` entries, in key order, kept while
    the entries *before* each are <= ``max_entries`` (the crossing one is
    kept).  ``lengths``: one row per history."""
    d = lengths.where(F.col(n) >= min_len)
    if max_entries is None:
        return d.withColumn("before", F.lit(None).cast("bigint"))
    # at most max_entries histories can be kept: a bounded top-k by key
    head = d.orderBy(seq).limit(max_entries)
    w = Window.orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    head = head.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint"))
    return head.where(F.col("before") <= max_entries)


def scan_stats(kept: DataFrame, seq: str, n: str, width: Column) -> DataFrame:
    """(#histories, #entries, vector width of the last kept history)."""
    return kept.agg(F.count(F.lit(1)).cast("bigint").alias("n_seqs"),
                    F.sum(n).cast("bigint").alias("n_entries"),
                    F.max_by(width, F.col(seq)).alias("width"))


def wide_vectors(df: DataFrame, key: str, vec: str, width: int, prefix: str = "t") -> DataFrame:
    """One column per vector element: t0 .. t{width-1}."""
    return df.select(key, *[F.col(vec).getItem(i).alias(f"{prefix}{i}") for i in range(width)])


def add_column(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """Widen a table with a typed, all-null column."""
    return df.withColumn(name, F.lit(None).cast(dtype))


class TraceStore:
    """Sampler snapshots, one Parquet table per array, by ``iter``.

    Every append writes its tables into folders of its own and then adds one
    file to ``commits``, with the iterations of each of its tables.  That
    file appears as a whole or not at all, so an append counts as a whole or not
    at all: what a failed one has left behind is in no commit and is never read.
    An iteration is read from the newest commit that holds it, so a repeated
    append replaces.  One writer at a time.
    """

    COMMIT = "number bigint, folder string, erase boolean, name string, iters array<bigint>"

    def __init__(self, root: str):
        self.root = root

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def commits(self, spark: SparkSession) -> DataFrame:
        """The commits that count: those since the last that erased."""
        try:
            c = spark.read.schema(self.COMMIT).json(self.path("commits"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], self.COMMIT)
        erased = c.where("erase").agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
        return c.where(F.col("number") >= erased)

    def append(self, tables: dict[str, DataFrame], erase: bool = False) -> None:
        """Write each table (which carries an ``iter`` column), then commit;
        ``erase`` replaces what was stored, otherwise iterations are added, or
        replaced where they were stored before."""
        spark = next(iter(tables.values())).sparkSession
        number = 1 + (self.commits(spark).agg(F.max("number")).first()[0] or 0)
        folder = f"commit={number}-{uuid.uuid4().hex}"
        rows = []
        for name, df in tables.items():
            at = os.path.join(self.path(name), folder)
            df.write.partitionBy("iter").parquet(at)
            iters = spark.read.schema(df.schema).parquet(at).agg(
                F.sort_array(F.collect_set(F.col("iter").cast("bigint")))).first()[0]  # a number for each iteration
            rows.append((number, folder, erase, name, iters))
        # one task: one file, renamed into place
        spark.createDataFrame(rows, self.COMMIT).coalesce(1).write.mode("append").json(self.path("commits"))

    def held(self, spark: SparkSession, table: str) -> dict[int, str]:
        """Folder of every iteration of a table: a row for each iteration."""
        c = self.commits(spark).where(F.col("name") == table)
        c = c.select("number", "folder", F.explode("iters").alias("iter")).groupBy("iter").agg(
            F.max_by("folder", "number").alias("folder"))
        return {r["iter"]: r["folder"] for r in c.collect()}

    def _load(self, spark: SparkSession, table: str, held: dict[int, str]) -> DataFrame:
        root = self.path(table)
        # only the folders of these iterations are listed and scanned
        paths = [os.path.join(root, folder, f"iter={i}") for i, folder in sorted(held.items())]
        return spark.read.option("basePath", root).parquet(*paths).drop("commit")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """Every iteration of a table."""
        held = self.held(spark, table)
        if not held:
            raise ValueError(f"no committed iteration of {table} in {self.root}")
        return self._load(spark, table, held)

    def latest(self, spark: SparkSession, tables: list[str]) -> dict[str, DataFrame]:
        """The last iteration that all the tables have."""
        held = {t: self.held(spark, t) for t in tables}
        common = set.intersection(*(set(h) for h in held.values()))
        if not common:
            raise ValueError(f"no iteration common to {tables} in {self.root}")
        last = max(common)
        return {t: self._load(spark, t, {last: h[last]}) for t, h in held.items()}

"""Driver tables and the adapter views that present them in the shapes the
career-path jobs expect (person -> ordered stints, titles, symbols, ...).

Views are plain DataFrame plans: Catalyst prunes the columns each job needs
down to the parquet scan and pushes filters into it.  No view broadcasts a
table that grows with the data -- joins are left to AQE, which switches to a
broadcast only when the measured shuffle output is under
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtrails.functions.location import STATE_ABBREV, STATE_NAMES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).lineitem`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)


def _pick(key: Column, values: list[str]) -> Column:
    """values[key]: a literal lookup without a join."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def jobs_v(t: Tables, columns: Sequence[str] = ("company", "title", "location"),
           keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stints: person = customer, company = supplier, title = part name.

    Dates are month precision and some are deliberately missing.  With ``keep``
    the joined rows, with these ``columns``, are written between the joins and
    the numbering by person, so that the shuffles of both aren't on disk together.
    """
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    # named before the window: what groups by person after it needs no further shuffle
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("person_id"), "o_orderdate")
    p = t.part.select("p_partkey", "p_name", "p_type")
    s = t.supplier.select("s_suppkey", "s_name")
    lo = F.to_date(F.date_trunc("month", F.least("o_orderdate", "l_shipdate")))
    hi = F.to_date(F.date_trunc("month", F.greatest("o_orderdate", "l_shipdate")))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey)
           .join(s, li.l_suppkey == s.s_suppkey))
    text = {"company": F.col("s_name"), "title": F.col("p_name"), "location": F.lower("p_type")}
    j = j.select(
        *order, "person_id",
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0, None)
         .otherwise(lo).alias("start_dt"),
        F.when((F.col("l_orderkey") + F.col("l_partkey")) % 7 == 0, None)
         .otherwise(hi).alias("end_dt"),
        *[text[c].alias(c) for c in columns])
    if keep:
        j = keep(j)
    w = Window.partitionBy("person_id").orderBy(*order)
    return j.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in order]).alias("job_id"),
        "person_id",
        F.row_number().over(w).cast("bigint").alias("pos"),
        "start_dt", "end_dt", *columns)


def titles_v(t: Tables) -> DataFrame:
    """Noisy titles in document order; every ninth is missing."""
    j = jobs_v(t)
    return j.select(
        "person_id", "pos",
        F.year("start_dt").cast("bigint").alias("start_year"),
        F.when(F.col("pos") % 9 == 0, None)
         .otherwise(F.concat(F.col("title"), F.lit(" ("), F.col("location"), F.lit(") #"),
                             F.col("pos").cast("string"))).alias("title"),
    )


def events_v(t: Tables) -> DataFrame:
    """Clean symbol sequences: one per user, ordered by time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(
        F.col("user_id").alias("person_id"),
        F.row_number().over(w).cast("bigint").alias("pos"),
        F.col("event_id").alias("job_id"),
        F.col("event_type").alias("title"),
        "value",
    )


def docs_v(t: Tables) -> DataFrame:
    """Free-text descriptions; person = document source, in order of doc_id
    (``pos`` orders a person's documents, it doesn't number them: a source may
    hold a third of all)."""
    return t.documents.select(
        F.col("doc_id").alias("job_id"),
        F.col("source").alias("person_id"),
        F.col("doc_id").alias("pos"),
        F.col("text").alias("description"),
        "lang",
    )


def topics_v(t: Tables) -> DataFrame:
    """A non-negative 64-wide topic vector per job, five jobs per person.

    ``state`` is a ready-made document state (used by the state-table jobs).
    """
    return t.embeddings.select(
        F.col("vec_id").alias("job_id"),
        F.floor(F.col("vec_id") / 5).cast("bigint").alias("person_id"),
        (F.col("vec_id") % 5).alias("pos"),
        F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("embedding"),
        F.col("label").alias("state"),
    )


def trace_v(t: Tables) -> DataFrame:
    """Twenty pseudo sampler iterations of state->state counts."""
    e = events_v(t)
    w = Window.partitionBy("person_id").orderBy("pos")
    pairs = e.select("job_id", F.col("title").alias("s1"),
                     F.lead("title").over(w).alias("s2"))
    return (pairs.where(F.col("s2").isNotNull())
                 .groupBy((F.col("job_id") % 20).alias("iter"), "s1", "s2")
                 .agg(F.count(F.lit(1)).alias("n")))


def cust_v(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("resume_id"),
        F.col("c_mktsegment").alias("currency"),
        F.col("c_acctbal").alias("salary"),
        F.col("c_nationkey").alias("state_id"),
    )


# The twelve raw location strings of the locs_v fixture, by key.
LOCS_FIXTURE = [
    "boston ma", "new york new york", "New York, NY", "austin texas usa",
    "chapel hill north carolina", "old hickorytn", "paris", "chapelhill nc", "",
    " san juan puerto rico ", "washington dc", "charleston west virginia",
]

# Places of the made-up locations and addresses, and the countries of some.
PLACES = ["springfield", "salem", "mount airy", "fairview", "new castle", "saint paul", "west point", "north bend",
          "Clinton", "porto alegre", "washington"]
COUNTRIES = ["USA", "Canada", "France"]


def _place(key: Column) -> tuple[Column, Column, Column]:
    """Place, state name and state code of a key."""
    state = (key * 13) % len(STATE_NAMES)
    return (_pick((key * 7) % len(PLACES), PLACES), _pick(state, STATE_NAMES),
            _pick(state, [STATE_ABBREV[n] for n in STATE_NAMES]))


def locs_v(t: Tables) -> DataFrame:
    """Location strings: every third dozen is the fixture's; the others put a
    place and a state together in six ways; some are missing."""
    key = F.col("c_custkey")
    place, state, code = _place(key)
    made = [F.concat(place, F.lit(" "), F.lower(state)), F.concat(place, F.lit(", "), code),
            F.concat(place, F.lower(code)), place, F.concat(place, F.lit(" "), state, F.lit(" USA")),
            F.concat(F.lit(" "), place, F.lit("  "), F.lower(code), F.lit(" "))]
    form = F.coalesce(*[F.when(key % len(made) == i, c) for i, c in enumerate(made)])
    return t.customer.select(
        key.alias("job_id"),
        F.when(F.floor(key / 12) % 3 == 0, _pick(key % 12, LOCS_FIXTURE)).when(key % 97 != 0, form).alias("location"),
    )


def addr_v(t: Tables) -> DataFrame:
    """Comma addresses of one to five parts."""
    key = F.col("c_custkey")
    place, state, _ = _place(key)
    country = _pick(key % len(COUNTRIES), COUNTRIES)
    parts = [place, F.concat(place, F.lit(" County")), state, F.lpad((key * 31 % 100000).cast("string"), 5, "0"), country]
    made = [parts, [*parts[:3], country], [place, state, country], [place, country], [country]]
    return t.customer.select(
        key.cast("bigint").alias("job_id"),
        F.coalesce(*[F.when(key % len(made) == i, F.concat_ws(", ", *c)) for i, c in enumerate(made)]).alias("address"),
    )


def topic_words_v(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_partkey")
    p = t.part.select("p_partkey", "p_name")
    return (li.join(p, li.l_partkey == p.p_partkey)
              .groupBy((F.col("l_partkey") % 64).alias("topic"), F.col("p_name").alias("word"))
              .agg(F.count(F.lit(1)).alias("n")))


def conv_v(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text")


def pages_v(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", "html")

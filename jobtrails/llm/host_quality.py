"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets rule figures and a base verdict; the failures are summed
by host, each host's failure rate is shrunk towards the corpus with a beta
prior fitted by the method of moments, and the host's verdict is joined back.

Edge cases: a null or empty text has no words and fails on length.  A null
host is no host: its documents keep their base verdict.  Repeated rows each
count.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrails.llm.common import SPACES, WORD, materialise

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
#: a host goes when its shrunk failure rate is above this share
MAX_HOST_RATE = 0.6
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body`` (else the optimiser would inline a
    repeated expression everywhere it is used)."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside a window of eight words that occurs at least twice in the
    same text.  Windows are compared by a 64-bit hash: sorted, equal
    neighbours mark the repeated ones, and their positions' union is summed."""
    def positions(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                           lambda i: F.struct(F.xxhash64(F.slice(w, i, WINDOW)).alias("h"), i.alias("p")))

    def marked(s):
        # neighbours of the sorted list, without indexing it from a lambda
        both = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                          lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    def union(p):
        rest = F.greatest(F.size(p) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(p, F.lit(1), rest), F.slice(p, F.lit(2), rest),
                          lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g))

    found = let(F.array_sort(positions(words)), lambda s: let(marked(s), union))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found).cast("bigint")


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the figures of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = docs.select("doc_id", F.col(host).alias("host"),
                    let(words, lambda w: F.struct(
                        F.size(w).cast("bigint").alias("n_words"),
                        F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
                        repeated_words(w).alias("n_repeat_words"))).alias("w"),
                    F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
                    let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    d = d.select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk), host_kept.

    The prior's mean m is the corpus failure rate and its strength s = m(1-m)/v - 1
    for the variance v of the hosts' rates about m, weighted by documents and less
    the part that sampling explains; where nothing is left of v, hosts don't differ
    and s is the number of documents of all hosts.
    """
    hosts = rules.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("base_failed").cast("bigint")).alias("host_failed"))
    n, x = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.count(F.lit(1)).alias("k"),
                      F.sum(x * x / n).alias("xx"))
    m = F.col("x") / F.col("n")
    spread = F.col("xx") / F.col("n") - m * m          # weighted variance of the rates
    noise = m * (1 - m) * F.col("k") / F.col("n")      # what binomial sampling alone gives
    v = spread - noise
    strength = F.when((v > 0) & (m > 0) & (m < 1), F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(F.col("n"))
    prior = total.select(F.struct(m.alias("m"), strength.cast("double").alias("s"))).scalar()
    rate = (x + prior["m"] * prior["s"]) / (n + prior["s"])
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= max_rate)


def quality_filter(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Figures, base verdict, host rate and final verdict of every document."""
    rules = materialise(document_rules(docs, host), "host-rules")
    hosts = host_verdicts(rules, max_rate).select("host", "host_rate", "host_kept")
    return rules.join(hosts, "host", "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True)))

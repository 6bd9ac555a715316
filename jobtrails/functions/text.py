"""Column expressions for names, titles and free text.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen.  Java regexes: ``\\p{Punct}`` is exactly the 32 ASCII
punctuation characters; ``\\w`` is ASCII-only, so word characters are spelled
``[\\p{L}\\p{N}_]`` to match Unicode-aware tokenisers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard 179-word English stop-word list (the one the
# reference loads from its NLP toolkit), in its published order.
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

WORD = r"[\p{L}\p{N}_]"
# word runs, or runs of anything that is neither a word character nor space (the
# letters a-z and digits, most of all characters, are looked for first)
WORDPUNCT = r"[a-z0-9_\p{L}\p{N}]+|[^a-z0-9_\p{L}\p{N}\s\p{Z}]+"
ALPHA = r"^\p{L}+$"
_EDGE_SPACE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def stopword_array() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS])


def is_stopword(w: Column, stops: list[str] | None = None) -> Column:
    """Membership test; ``isin`` over many literals is planned as a hash-set
    lookup (InSet), not a scan of the list per token."""
    return w.isin(*(STOPWORDS if stops is None else stops))


def strip_ws(c: Column) -> Column:
    """Strip ASCII whitespace at both ends (``trim`` strips only spaces)."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def clean_name(c: Column, null_val: str | None = "") -> Column:
    """B1: drop non-ASCII, lower-case, delete ASCII punctuation, strip ends."""
    out = strip_ws(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "")),
                                    r"\p{Punct}", ""))
    return F.coalesce(out, F.lit(null_val)) if null_val is not None else out


def company_key(company: Column, location: Column, addloc: bool = True) -> Column:
    """B2: cleaned company, plus `` (location)`` when the location is not blank."""
    base = clean_name(company)
    if not addloc:
        return base
    has_loc = location.isNotNull() & (F.length(strip_ws(location)) > 0)
    return F.when(has_loc, F.concat(base, F.lit(" ("), clean_name(location), F.lit(")"))) \
            .otherwise(base)


def split_company_key(key: Column) -> tuple[Column, Column]:
    """Inverse of B2: (company, location) split at the first `` (``."""
    has = F.instr(key, " (") > 0
    parts = F.split(key, r" \(", 2)
    company = F.when(has, parts.getItem(0)).otherwise(key)
    loc = F.when(has, F.regexp_replace(parts.getItem(1), r"\)+$", "")).otherwise(F.lit(""))
    return strip_ws(company), strip_ws(loc)


def clean_title(c: Column) -> Column:
    """Lower-case, keep ASCII letters and spaces only.  What is kept is
    taken out and joined, which costs a sixth of removing all else."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z ]+"), 0), "")


def clean_title_loose(c: Column) -> Column:
    """The older title cleaner.  Its pattern looks for 12+ capitals or
    spaces but runs on lower-cased text, so only long blank runs vanish."""
    return F.regexp_replace(F.lower(c), "[A-Z ]{6,}[A-Z ]{6,}", "")


def tokens_wordpunct(c: Column) -> Column:
    """Lower-case, then runs of word characters or of punctuation."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORDPUNCT), 0)


def whitespace_tokens(c: Column) -> Column:
    """Whitespace split without empty pieces (Python's ``str.split()``)."""
    return F.filter(F.split(c, r"[\s\p{Z}]+"), lambda w: F.length(w) > 0)


def tokens_nostop(c: Column) -> Column:
    """Whitespace tokens, lower-cased, stop-words removed."""
    return F.filter(F.transform(whitespace_tokens(c), lambda w: F.lower(w)),
                    lambda w: ~is_stopword(w))


def tokens_nostop_alpha(c: Column) -> Column:
    """As B12 but alphabetic tokens only."""
    return F.filter(tokens_nostop(c), lambda w: w.rlike(ALPHA))

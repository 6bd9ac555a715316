import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score string, h int, k string, "
          "fp string, th int, item_ids string, starts int, part int, margin double, rate string")
EXTRA = ("s", 1, "k", "f", 2, "i", 3, 4, 0.5, "r")


def words(rng: random.Random, n: int, stems="ka lo mi tu re sa po ne".split()) -> list[str]:
    return ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def rows_of(texts, langs=None):
    return [(i, t, (langs or {}).get(i, "en"), f"src{i % 3}", len(t or ""), *EXTRA) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """docs from texts, or from whole rows, with columns whose names clash with the operators' own."""
    def build(texts=None, rows=None):
        return spark.createDataFrame(rows if rows is not None else rows_of(texts or []), SCHEMA).repartition(3)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty values, white space, repeated rows, ties and a very long text."""
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000))
    base = " ".join(words(rng, 80))
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "ä é 漢字", base, base, base + " tail", long, "1234 %%% ###",
             "x" * 5000, "no-break\u00a0space\u2003here", "line\nline\nline\n"]
    rows = rows_of(texts)
    rows.append(rows[5])                      # a repeated row
    rows.append((None, base, None, None, None, *EXTRA))
    rows.append((None, None, None, None, None, *[None] * len(EXTRA)))
    return rows

import random

import pytest


@pytest.fixture()
def docs(spark):
    """Rows to a documents table; each row gives doc_id, text, lang and source."""

    def make(rows, **extra):
        full = [(d, t, lang, source, len(t) if t else None) for d, t, lang, source in rows]
        out = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return out.selectExpr("*", "1 AS key", "'x' AS fp", "2L AS size", "0.5D AS score", "'c' AS component", "3L AS run")

    return make


@pytest.fixture(scope="session")
def prose():
    """Reproducible prose of invented words."""

    def make(n, seed, stems=("ka", "lo", "mi", "ten", "sur", "pol", "eb", "an")):
        r = random.Random(seed)
        return " ".join("".join(r.choices(stems, k=r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture()
def odd_rows(prose):
    """Nulls, blanks, ties, repeated rows, a long text and odd characters."""
    return [
        (1, None, None, None), (2, "", "en", "s"), (3, " \t\n", "en", None), (4, "one", None, "s"), (5, "one two three", "en", "s"),
        (6, prose(120, 1), "en", "s"), (7, prose(120, 1), "fr", "t"), (7, prose(120, 1), "fr", "t"), (8, prose(30_000, 2), "en", "t"),
        (9, "ÄÖ naïve 你好 ﬁ ́x   <|endoftext|> 😀", "de", "t"), (None, prose(60, 3), "en", "s"), (2**60 + 1, "big id", "en", "s"), (-5, "x" * 50_000, "en", "s"),
    ]

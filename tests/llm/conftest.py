import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""
    def made(pairs, extra=True):
        rows = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            df = df.selectExpr("*", "1 AS words", "2 AS cell", "3 AS start", "'x' AS kind", "4 AS length", "5 AS first")
        return df
    return made


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "x", "été", "日本", "a.b@c.org", "10.0.0.1", "+1 (456) 555-2186", "12"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "two words"), (None, "no id here at all"),
        (7, long), (8, "a" * 50_000), (9, "tab\tand\x0bvt \x1c\u00a0\u3000 nbsp\r\nend  "), (10, "<|endoftext|> it's 've\n\n\nx"),
        (5, "same id other text"),
    ]

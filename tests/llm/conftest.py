"""Made-up documents with the awkward cases."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(n))


def table(spark, texts: dict, **columns):
    """Documents by id; further columns are the same in all rows."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in columns.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="session")
def awkward() -> list[tuple]:
    """Null, empty, blank and very long texts, null and repeated ids, repeated rows, and odd characters."""
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, words(30_000, 1)), (None, words(50, 2)), (5, words(50, 3)), (5, words(50, 3)), (6, words(50, 3)),
        (7, "don't l'eau <|endoftext|> Été ΣΣ 中文 ½² !!$$ \x00\x7f"), (8, "x"), (9, "́́ é"), (-3, words(5, 4)), (1 << 40, words(400, 5)),
    ]

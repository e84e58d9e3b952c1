"""Fill-in-middle against its definition in plain Python."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelake.llm import infilling
from tests.llm.conftest import table, words

LINES = [(20, "one\ntwo\nthree\n"), (21, "\n\n\n"), (22, "no end"), (23, "é\n中文\n\U0001f600x"), (24, "has <P> in it\nb"), (25, "a\r\nb\rc d\n"), (26, "x < S > <M\n>\n<"), (27, "\n" * 5000 + "end")]


def brute(doc_id, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if text == "" or any(m in text for m in marks) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(prefix), len(middle), (s + suffix + p + prefix if form == "spm" else p + prefix + s + suffix) + m + middle


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=60))
def test_lists_give_back_their_values(values):
    values = sorted(values)
    held = infilling.elias_fano(np.array(values, np.int64))
    assert [held.select(k) for k in range(len(values))] == values
    with pytest.raises(IndexError):
        held.select(len(values))


def test_lists_are_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 100, 10_000))
    held = infilling.elias_fano(values)
    assert len(held.low) + len(held.high) < 10_000 * (2 + 6) / 8 + 16  # log2 of the mean gap and two bits each


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n\ré中\U0001f600", max_size=40))
def test_lines(text):
    assert infilling.line_ends(text).tolist() == np.cumsum([len(u) for u in re.findall("[^\n]*\n|[^\n]+", text)], dtype=int).tolist()


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm": 20}, {"marks": ("[.P.]", "[.S.]", "[.M.]")}])
@pytest.mark.parametrize("full", [False, True])
def test_documents(spark, awkward, options, full, monkeypatch):
    """Alone or through the index (a full filter sends all texts there) the result is the same."""
    if full:
        monkeypatch.setattr(infilling, "maybe", lambda bits, place: np.ones(len(place), bool))
    monkeypatch.setattr(infilling, "FLUSH", 3000)
    rows = awkward + LINES + [(30 + k, words(20, 1).replace(" ", "\n")) for k in range(40)] + [(None, None), (40, words(9, 2) + "\n")]
    docs = table(spark, rows, output="clash", key="clash", place=1, form="x").repartition(5)
    made = infilling.fill_in_middle(docs, **options)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = made.withColumn("back", infilling.restore(F.col("output"), F.col("form"), options.get("marks", infilling.MARKS))).collect()
    assert sorted((tuple(r)[:-1] for r in out), key=repr) == sorted((brute(i, t, **options) for i, t in rows), key=repr)
    assert sorted((r["doc_id"] or 0, r["back"]) for r in out) == sorted((i or 0, t or "") for i, t in rows)


def test_a_list_is_made_once_for_a_text(spark):
    rows = [(k, "a\nb\nc" if k % 3 else "d\ne") for k in range(300)]
    index = infilling.distinct_lines(table(spark, rows).withColumn("key", F.unhex(F.sha2("text", 256))).select("key", "text").repartition(6))
    assert sorted((r["text"], r["n"]) for r in index.collect()) == [("a\nb\nc", 3), ("d\ne", 2)]


def test_nothing(spark):
    assert infilling.fill_in_middle(table(spark, [])).collect() == []

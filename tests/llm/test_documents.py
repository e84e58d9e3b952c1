"""Decontamination, language identification and licences on small cases."""

import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import decontamination as D
from kinelake.llm import language, licences
from kinelake.llm.queries import digest_matches
from tests.llm.conftest import table, words

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        out.append((i, len(w), len(hit), len(found)))
    return sorted(out, key=repr)


def found(spark, docs, items, **columns):
    index = D.build_index(table(spark, docs, **columns).repartition(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in digest_matches(D.phrase_matches(index, bench)).collect()), key=repr)


@pytest.fixture(scope="module")
def case(awkward):
    items = [(k, words(random.Random(k).randint(10, 40), 900 + k)) for k in range(30)] + [(30, "Ab, cd"), (31, None), (32, ""), (None, words(20, 1)), (0, words(15, 77)), (33, "a a a a a a a a a a a")]
    docs = list(awkward)
    for k in range(60):
        t = words(100, k).split()
        w = (items[k % 30][1] or "").upper().split()
        t[20:20] = w[: 5 + k % 30]
        docs.append((100 + k, ", ".join(t)))
    docs += [(300, "x ab-CD y"), (301, "a " * 40), (302, items[3][1]), (303, items[3][1] + " " + items[4][1])]
    return docs, items


def test_hits_equal_brute_force(spark, case):
    assert found(spark, *case, segment=1, place="clash", n_words=3) == brute(*case)


def test_items_in_several_blocks(spark, case, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 40)
    assert found(spark, *case) == brute(*case)


def test_small_segments_and_lookups(spark, case, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(D, "LOOKUPS", 7)
    docs, items = case
    data = "\n".join(t or "" for _, t in docs)
    assert data
    assert found(spark, docs, items) == brute(docs, items)


def test_nothing(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a b")], []) == [(1, 2, 0, 0)]


def test_proximity(spark):
    index = D.build_index(table(spark, {1: "one two three four five", 2: "one x x x x x x x two"}))
    near = lambda w, s: sorted(r["doc_id"] for r in D.proximity_matches(index, w, s).collect())
    assert near(["One", "two"], 3) == [1]
    assert near(["one", "two"], 8) == [1, 2]
    assert near(["one", "seven"], 8) == []
    with pytest.raises(ValueError):
        D.proximity_matches(index, ["two words"])


# ------------------------------------------------------------ languages

SYLLABLES = {"aa": "ka mo ti re su no", "bb": "schn ung eit ber ver", "cc": "eau ille oux ch é", "dd": "ción rr ñ oso as"}


def made(lang, n, seed):
    r = random.Random(seed)
    own = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(own) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages(spark, awkward):
    rows = [(k, made(lang, 40, k), lang) for k, lang in enumerate(list(SYLLABLES) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_codes(docs.filter(~language.held_out()))
    assert model.codes.shape == (4, 7)
    out = language.identify(docs.withColumn("score", F.lit("clash")), model).filter(language.held_out()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    odd = language.identify(table(spark, awkward + [(50, "12345 $$ \n"), (51, "中文")]), model).collect()
    und = {r["doc_id"] for r in odd if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 50}
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert len(odd) == len(awkward) + 2


def test_no_labels_and_one_label(spark):
    docs = table(spark, {1: "some text"})
    none = language.train_codes(docs.withColumn("lang", F.lit(None).cast("string")))
    assert language.identify(docs, none).first()["lang_pred"] == "und"
    one = language.identify(docs, language.train_codes(docs)).first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)
    assert language.identify(table(spark, []), none).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 5, 7, 12, 40):
        c = language.codewords(n).astype(int)
        gaps = (c.shape[1] - c @ c.T) // 2 + np.eye(n, dtype=int) * 99
        assert gaps.min() >= (1 if n == 2 else 2)


# ------------------------------------------------------------ licences


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train_licences(table(spark, {k: words(200, k) for k in range(50)}), documents=40)


def test_licences(spark, licence_model, awkward):
    notices = {f: t[0] for f, t in licences.TEMPLATES.items()}
    docs = list(awkward) + [(1000 + k, f"{words(50, k)}\n{t}\n{words(50, k)}") for k, t in enumerate(notices.values())] + [(2000 + k, t) for k, t in enumerate(licences.OTHERS)] + [(3000, words(200, 99))]
    rows = {r["doc_id"]: r for r in licences.scan_licences(table(spark, docs, notices=1), licence_model).collect() if r["doc_id"] is not None}
    for k, family in enumerate(notices):
        got = rows[1000 + k]
        assert [(n["paragraph"], n["family"]) for n in got["notices"]] == [(1, family)], family
        assert got["n_paragraphs"] == 3
    assert not any(r["notices"] for i, r in rows.items() if i < 1000 or i >= 2000)
    assert rows[1]["n_paragraphs"] == rows[2]["n_paragraphs"] == rows[3]["n_paragraphs"] == 0
    assert licences.scan_licences(table(spark, []), licence_model).count() == 0


def test_reworded_and_cut_notices(spark, licence_model):
    texts = {1: "This file is licensed under the Apache License, Version 2.0, by its authors", 2: "licensed under a license of the public library"}
    rows = {r["doc_id"]: [n["family"] for n in r["notices"]] for r in licences.scan_licences(table(spark, texts), licence_model).collect()}
    assert rows == {1: ["apache"], 2: []}


@pytest.mark.parametrize("width", [60, 72, 80])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_and_surrounded_notices(spark, licence_model, width, mark):
    """Notices wrapped over lines, with comment marks, and in the middle of a long line; not across a blank line."""
    own = [(f, t) for f in ("mit", "bsd", "apache", "gpl", "lgpl") for t in licences.TEMPLATES[f] if len(t) > 100]
    texts = {k: "\n".join(mark + x for x in [words(8, k), "", *textwrap.wrap(t, width), "", words(8, k + 1)]) for k, (_, t) in enumerate(own)}
    texts |= {100 + k: f"{words(150, k)} {t} {words(150, k + 1)}" for k, (_, t) in enumerate(own)}
    texts[200] = "Permission is hereby granted,\n\nfree of charge,\n\nto any person obtaining a copy"
    rows = {r["doc_id"]: r["notices"] for r in licences.scan_licences(table(spark, texts), licence_model).collect()}
    assert {k: [n["family"] for n in rows[k]] for k in range(len(own))} == {k: [f] for k, (f, _) in enumerate(own)}
    assert {k: [n["family"] for n in rows[100 + k]] for k in range(len(own))} == {k: [f] for k, (f, _) in enumerate(own)}
    assert rows[0][0]["paragraph"] == 1 and rows[200] == []

"""The registered queries themselves: columns, types, and results against their SQL or plain Python, on the smallest tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from kinelake.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA, requires_data
from tests.llm.test_secrets import base
from tests.test_entry import rows

pytestmark = requires_data
TYPES = {
    "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_warc_conversion": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(db):
    return db.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def results(spark):
    kept = {}

    def of(name):
        if name not in kept:
            df = QUERIES[name](spark, DATA)
            assert dict(df.dtypes).items() >= TYPES.get(name, {}).items()
            kept[name] = df.collect()
        return kept[name]

    return of


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(k) for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), db.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_secrets(results, documents):
    got = {r["doc_id"]: r for r in results("op1_secret_scan")}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        spans = base(text)
        names = ("assign", "access", "hex")
        written = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        assert [got[i][f"n_{n}"] for n in names] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("markov")] == written


def tokens(text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens.tool = getattr(tokens, "tool", None) or Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return [*tokens.tool.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(results, documents):
    found = sorted(results("op3_best_fit_packing"), key=lambda r: (r["doc_id"], r["piece"]))
    expected, total = [], 0
    for i, text, _ in documents:
        ids = tokens(text, 1)
        total += len(ids)
        expected += [(i, k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
    assert [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found] == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len(sequences) <= 1.05 * -(-total // 4096) + 1


def test_token_files(results, documents):
    at, expected = 0, []
    for i, text, _ in documents:
        ids = tokens(text, 2)
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in results("op4_token_files")) == expected


def test_languages(results, documents):
    truth = {i: (text, lang) for i, text, lang in documents}
    hits = asked = 0
    for r in results("op6_language_id"):
        text, lang = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and lang:
            asked += 1
            hits += r["lang_pred"] == lang
    assert asked >= 30 and hits >= 0.9 * asked


def test_neighbours(results, db):
    vectors = dict(db.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()], float)
    found = {}
    for r in results("op7_nearest_neighbours"):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in [i for i in ids.tolist() if i % 20 == 0]:
        s = x @ np.array(vectors[q], float)
        own = sorted(found[q])
        assert [k for k, _, _ in own] == list(range(1, 21))
        assert all(score == pytest.approx(s[np.searchsorted(ids, v)], abs=1e-12) for _, v, score in own)
        best = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        hits += len(set(best) & {v for _, v, _ in own})
    assert hits >= 0.95 * 20 * len(found)

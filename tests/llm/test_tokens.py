"""Tokens, packing and token files against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import packing, token_files, tokens
from tests.llm.conftest import SCHEMA, table, words

PATH = tokens.default_vocabulary()
PARTS = ["don't", "l'eau", "I'LL", "'s", " ", "\n", "<|endoftext|>", "<|x|>", "é", "É", "é", "Σ", "ς", "İ", "ß", "ẞ", "1", "23", "½", "…", "—", "!!", "$$", "a", "Zz", "中", " ", "\x1c", "\x00", "\x7f", "ﬁ", "한", "ᅡ", "_", "ǅ", "ª", "µ", "١"]


def library(text):
    return tokens.tokenizer(PATH).library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(texts, limit=2000):
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    out = []
    for _, _, ids, counts in tokens.encoded_blocks(batch, "text", PATH, limit):
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def test_same_as_the_library():
    r = random.Random(5)
    texts = [None, ""] + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 12))) for _ in range(4000)]
    assert encoded(texts) == [library(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_same_as_the_library_on_anything(texts):
    assert encoded(texts) == [library(t) for t in texts]


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    texts = [words(40, k) for k in range(20)]
    assert encoded(texts, 300) == [library(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit(lengths):
    n = np.array(lengths, np.int64)
    bins, offsets, fills = packing.best_fit(n, 50)
    assert (fills <= 50).all()
    assert fills.sum() == n.sum()
    for b in range(len(fills)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert (offsets[own] == np.cumsum(n[own]) - n[own]).all()
    assert sum(f <= 25 for f in fills) <= 1


def check_packing(rows, texts, capacity):
    pieces = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = {}
    for r in pieces:
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= capacity for n in at.values())
    expected = sorted((i is not None, i or 0, k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for i, t in texts for ids in [library(t) + [1]] for k, s in enumerate(range(0, len(ids), capacity)))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    return len(at), -(-sum(x[4] for x in expected) // capacity)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 50), st.integers(1, 30)), max_size=30, unique_by=lambda x: x[:2]), st.integers(0, 8), st.integers(0, 20))
def test_a_node_accounts_for_all_items(items, slack, whole):
    """Each item is in one range; sequences hold items beside each other without gaps, and so do bins that rise."""
    child, fill, count = (np.array([x[k] for x in items], np.int64) for k in range(3))
    rules, rises, sequences = packing.pack_node(child, fill, count, 50, slack, max(whole, slack))
    seen, inside, alone = set(), {}, set()
    for kind, c, f, first, n, to_fill, to, phase, per, offset in rules:
        for i in range(n):
            assert (c, f, first + i) not in seen
            seen.add((c, f, first + i))
            inside.setdefault((kind, to_fill, to + (phase + i) // per), []).append((offset + (phase + i) % per * f, f))
    assert seen == {(c, f, i) for c, f, n in items for i in range(n)}
    for (kind, to_fill, _), own in inside.items():
        ends = np.cumsum([f for _, f in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()]
        assert 50 - slack <= ends[-1] <= 50 if kind == packing._DONE else ends[-1] == to_fill
    assert sorted(k[2] for k in inside if k[0] == packing._DONE) == list(range(sequences))
    assert {f: sorted(k[2] for k in inside if k[0] == packing._RISES and k[1] == f) for f in rises} == {f: list(range(n)) for f, n in rises.items()}


TREES = [{}, {"partition": 20, "fan_in": 2}, {"partition": 30, "fan_in": 3, "slack": 40}]


@pytest.mark.parametrize("options", TREES)
def test_packing(spark, awkward, options):
    texts = awkward + [(100 + k, words(random.Random(k).randint(1, 300), k)) for k in range(200)]
    docs = table(spark, texts, length=7, piece="clash").repartition(7)
    rows = packing.pack_documents(docs, capacity=512, **options).collect()
    used, least = check_packing(rows, texts, 512)
    assert used <= least * 1.15 + 1


@pytest.mark.parametrize("order", ["by length", "shuffled", "one partition"])
def test_few_sequences_in_any_order(spark, order):
    """Within a hundredth of the fewest there could be, over several levels of nodes."""
    r = random.Random(3)
    texts = [(k, "x " * min(2000, int(r.lognormvariate(3.5, 1.2)))) for k in range(6000)]
    texts.sort(key=(lambda x: len(x[1])) if order == "by length" else (lambda x: (x[0] * 7919) % 6007))
    docs = spark.sparkContext.parallelize([(i, t, "", "", 0) for i, t in texts], 1 if order == "one partition" else 6).toDF(SCHEMA)
    rows = packing.pack_documents(docs, capacity=1024, slack=2, partition=300, fan_in=3).collect()
    used, least = check_packing(rows, texts, 1024)
    assert used <= 1.01 * least + 1


@pytest.mark.parametrize("options", TREES[:2])
def test_packing_doesnt_depend_on_order(spark, options):
    """Long documents in some tasks and short ones in others: a long and a short one fill a sequence."""
    texts = [(k, "x " * (39 if k < 300 else 23)) for k in range(600)]
    docs = table(spark, texts).repartitionByRange(4, "doc_id")
    rows = packing.pack_documents(docs, capacity=64, **options).collect()
    assert check_packing(rows, texts, 64) == (300, 300)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(table(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_codes_round_trip(ranks):
    r = np.array(ranks, np.uint32)
    control, data = token_files.encode_ranks(r)
    assert (token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(r)) == r).all()
    assert len(control) == -(-len(ranks) // 4)


def test_token_files(spark, awkward, monkeypatch):
    docs = table(spark, awkward, n=1, packed="clash", bucket=3).repartition(3)
    folder = token_files.write_token_files(docs)
    got = [(r["doc_id"], r["n_tokens"], r["ids"]) for r in sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])]
    expected = sorted(((i, t) for i, t in awkward), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g[0] for g in got] == [i for i, _ in expected]
    assert sorted(map(repr, got)) == sorted(repr((i, len(library(t)) + 1, library(t) + [2])) for i, t in awkward)
    starts = [r["start"] for r in sorted(token_files.digest_token_files(spark, folder).collect(), key=lambda r: r["start"])]
    assert starts == np.concatenate([[0], np.cumsum([g[1] for g in got])[:-1]]).tolist()


def test_token_files_of_nothing(spark):
    assert token_files.digest_token_files(spark, token_files.write_token_files(table(spark, []))).collect() == []


def test_ids_of_many_rows_are_dealt_to_several_buckets(rng):
    cuts = np.array([3, 7, 7, 7, 7, 9])
    ids, mark = rng.integers(0, 12, 5000), rng.integers(-(1 << 63), 1 << 63, 5000)
    ids[::2] = 7
    bucket = token_files._bucket(cuts, ids, mark)
    order = np.lexsort((mark, ids))
    assert (np.diff(bucket[order]) >= 0).all()
    assert set(bucket[ids == 7].tolist()) == {1, 2, 3, 4} and np.bincount(bucket[ids == 7]).max() < 1000
    assert set(bucket[ids > 9].tolist()) == {6} and set(bucket[ids <= 3].tolist()) == {0}


def test_damaged_shards_are_refused():
    shard = token_files._shard([1], [3], np.array([0, 1, 300], np.uint32))
    ids, counts, tokens_ = token_files.read_shard(shard, np.arange(400, dtype=np.uint32))
    assert tokens_.tolist() == [0, 1, 300]
    for bad in (b"x" + shard[1:], shard[:-1]):
        with pytest.raises(ValueError):
            token_files.read_shard(bad, np.arange(400, dtype=np.uint32))

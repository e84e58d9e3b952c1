"""Joins, graphs, archives and chats against brute force."""

import gzip
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import archives, chat, graph, jaccard, neighbours
from tests.llm.conftest import table, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=3):
    w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked_components(rows, percent, width=3):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, (_, s)), (b, (_, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def joined(spark, rows, percent=90, width=3, **columns):
    out = jaccard.jaccard_groups(table(spark, rows, **columns).repartition(3), percent=percent, width=width)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=repr)


def near(text, changes, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(changes):
        w[r.randrange(len(w))] = words(1, r.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(awkward):
    rows = list(awkward)
    for group, (size, n) in enumerate([(40, 25), (300, 40), (12, 15), (1500, 6), (3, 6), (2, 4)]):
        first = words(size, 50 + group)
        text = first
        for k in range(n):
            text = near(text, k % 4, 97 * group + k) if k % 3 else near(first, max(1, size * k // (90 * n)), k)
            rows.append((1000 * (group + 1) + k, text))
    rows += [(20_000, "A b"), (20_001, "a\tB"), (20_002, "a"), (20_003, "x y z"), (20_004, "X  Y\nZ")]
    return rows


def test_components_equal_brute_force(spark, copies):
    expected = linked_components(copies, 90)
    assert len({c for _, _, c in expected}) < len(copies) - 30
    assert joined(spark, copies, n=1, row="clash", component=2) == expected


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_other_thresholds(spark, copies, percent):
    few = copies[:70]
    assert joined(spark, few, percent, 5) == linked_components(few, percent, 5)


def test_trees_and_blocks_alone(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "FANOUT", 3)
    out = jaccard.jaccard_groups(table(spark, copies), percent=90, width=3, stars=0)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=repr) == linked_components(copies, 90)


def test_nothing(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_tree_join_equals_all_pairs(rng):
    p = rng.integers(0, 4, (90, jaccard.GROUPS)).astype(np.uint8)
    p[40:] = np.maximum(p[:50].astype(int) + rng.integers(-1, 2, (50, jaccard.GROUPS)) * (rng.random((50, jaccard.GROUPS)) < 0.05), 0).astype(np.uint8)
    n = p.sum(axis=1, dtype=np.int64)
    c = np.arange(90)
    tree = jaccard.RTree(p, n, c)
    a, b = tree.join(tree, 90)
    got = {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    bound = lambda i, j: jaccard.enough(int(np.minimum(p[i], p[j]).sum()), int(n[i] + n[j]), 90) and 100 * min(n[i], n[j]) >= 90 * max(n[i], n[j])
    assert got == {(i, j) for i, j in itertools.combinations(range(90), 2) if bound(i, j)}
    assert len(got) == len(a)


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (105, 105)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# ------------------------------------------------------------ neighbours


def test_neighbours(spark, rng):
    x = rng.normal(size=(400, 12)).astype("f4")
    x[50:90] = x[50]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0]), (904, [None] * 12), (None, [1.0] * 12), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = neighbours.build_graph(df.withColumn("node", F.lit(1)), k=8, sample=6, rounds=4)
    asked = df.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    out = neighbours.search(index, asked, k=10, beam=80).collect()
    exact = x.astype(float)
    hits = 0
    for q in range(0, 400, 20):
        s = exact @ exact[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:10]
        own = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [r["score"] for r in own] == pytest.approx([float(s[r["vec_id"]]) for r in own])
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in itertools.pairwise(own))
        hits += len({r["vec_id"] for r in own} & set(best.tolist()))
    assert hits / 200 > 0.9
    assert {r["query_id"] for r in out} == set(range(0, 400, 20))


def test_recall_over_several_shards(spark, rng, monkeypatch):
    """Unstructured and clustered vectors over eight shards, all queries, against brute force."""
    monkeypatch.setattr(neighbours, "SHARD_VECTORS", 250)
    x = rng.normal(size=(2000, 24))
    x[1000:] = x[rng.integers(0, 40, 1000)] + 0.1 * x[1000:]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = neighbours.build_graph(df)
    assert index.packed.count() == 8
    asked = df.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in neighbours.search(index, asked, k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(2000), -s))[:20].tolist()))
    assert hits / (100 * 20) > 0.95
    with pytest.raises(ValueError):
        neighbours.search(index, asked, k=21)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(20, [1.0, 0.0])], [(20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.5, 0.5])]):
        df = spark.createDataFrame(rows, schema)
        out = neighbours.search(neighbours.build_graph(df, rounds=1), df.filter("vec_id = 20").select(F.col("vec_id").alias("query_id"), "embedding"), k=20).collect()
        assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == [r[0] for r in rows if r[0] != 20]


# ------------------------------------------------------------ archives


def test_arc_round_trip():
    pages = [(1, "http://a/ b\n", b"x\n\nfiledesc"), (None, None, b""), (3, "u", bytes(range(256)))]
    for version in (1, 2):
        got = list(archives.read_arc(archives.write_arc(pages, version, "n.arc", "20010203040506")))
        assert [archives.split_http(r["block"])[1] for r in got] == [p for _, _, p in pages]
        assert [r["url"] for r in got] == ["http://a/%20b%0A", "-", "u"]
        assert archives.warc_date(got[0]["date"]) == "2001-02-03T04:05:06Z"
    whole = archives.write_arc(pages, 1, "n.arc", "2001")
    for bad in (whole[:-30], b"filedesc://n 0 0 t 3\nxyz\n", whole.replace(b"http://a", b"a b", 1)):
        with pytest.raises(ValueError):
            list(archives.read_arc(bad))


def test_conversion(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (7, "v", other), (8, "w", "small"), (9, "w", "small"), (10, "e", None), (11, "e", ""), (None, "n", other), (5, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit("clash")).repartition(3)
    files = archives.convert(archives.to_arc(df))
    got = sorted((tuple(r) for r in archives.read_back(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    last = {big: 5, other: 7}
    expected = [(i, len((t or "").encode()), digest(t), "revisit" if t in last and i != last[t] else "response", last[t] if t in last and i != last[t] else None) for i, _, t in rows]
    assert got == sorted(expected, key=repr)
    uri = files.first()["uri"]
    content = archives.read_bytes(uri)
    records = list(archives.read_warc(content))
    assert records == list(archives.read_warc(gzip.decompress(content)))
    assert all(h["warc-record-id"].startswith("<urn:uuid:") and h["warc-date"] == "1999-01-01T00:00:00Z" for h, _ in records)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.read_back(archives.convert(archives.to_arc(empty))).count() == 0


# ------------------------------------------------------------ chats


def maximal(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    lists = {c: [x[1:] for x in sorted(t, key=lambda t: t[0])] for c, t in convs.items()}
    return sorted((c, len(t)) for c, t in lists.items() if not any((len(o) > len(t) and o[: len(t)] == t) or (o == t and d < c) for d, o in lists.items() if d != c))


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 3)
    r = random.Random(4)
    turns = [[("user" if k % 2 == 0 else "assistant", words(3, 10 * s + k)) for k in range(9)] for s in range(5)]
    rows = []
    for c in range(60):
        own = turns[r.randrange(5)][: r.randint(1, 9)]
        start = r.randint(0, 2)
        rows += [(c, start + k, role, text) for k, (role, text) in enumerate(own)]
    rows += [(100, None, "user", None), (101, 0, None, ""), (102, 0, "user", "say <|im_end|> now"), (None, 0, "user", "lost"), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = chat.format_chats(df).collect()
    assert sorted((x["conv_id"], x["n_turns"]) for x in got) == maximal(rows)
    text = {x["conv_id"]: x["text"] for x in got}[102]
    assert text == "<|im_start|>user\nsay < |im_end|> now<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0

"""The Merkle manifest against plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelake.llm import merkle, runs
from tests.llm.conftest import SCHEMA, table, words


def digest(parts):
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def levels(leaves, arity):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, k, arity):
    out = []
    for level in tree[:-1]:
        first = k - k % arity
        out += [d for j, d in enumerate(level[first : first + arity], first) if j != k]
        k //= arity
    return out


def leaf(row, columns=merkle.COLUMNS):
    texts = ["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns]
    return hashlib.sha256("".join(texts).encode()).digest()


def brute(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([d for _, _, d in sorted(groups[g])], arity) for g in names}
    top = levels([trees[g][-1][0] for g in names], arity)
    out = []
    for j, g in enumerate(names):
        above = siblings(top, j, arity)
        for k, (known, i, d) in enumerate(sorted(groups[g])):
            out.append((i if known else None, g, d, k, len(groups[g]), j, len(names), trees[g][-1][0], top[-1][0], siblings(trees[g], k, arity) + above))
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(2, 4), st.randoms())
def test_parents_close_in_any_order(n, arity, r):
    """Children may come in any order and in parts; what stays open in the parts closes when they meet."""
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    order = list(range(n))
    r.shuffle(order)
    parts = [merkle.Parents(n, arity) for _ in range(3)]
    for k in order:
        parts[r.randrange(3)].add(0, k, leaves[k])
    last = merkle.Parents(n, arity)
    for p in parts:
        for level, place, d in p.frontier():
            last.add(level, place, d)
    tree = levels(leaves, arity)
    assert last.root == tree[-1][0] and last.frontier() == [(len(tree) - 1, 0, last.root)]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(2, 4))
def test_fold(n, arity):
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    tree = levels(leaves, arity)
    for k in range(n):
        assert merkle.fold(leaves[k], k, n, [*siblings(tree, k, arity), b"rest"], arity) == (tree[-1][0], [b"rest"])


def made(spark, texts, more=()):
    rows = [(i, t, [None, "en", "dé", ""][k % 4], None if k % 5 == 0 else "s", k) for k, (i, t) in enumerate(texts)] + list(more)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("arity", "small"), [(2, False), (2, True), (3, True)])
def test_manifest(spark, awkward, monkeypatch, arity, small):
    """With small runs and spans the frontiers go through several rounds."""
    if small:
        monkeypatch.setattr(merkle, "SPAN", 4)
        monkeypatch.setattr(merkle, "FAN", 2)
        monkeypatch.setattr(merkle, "LEAVES", 3)
        pack = runs.pack_runs
        monkeypatch.setattr(merkle, "pack_runs", lambda *a: pack(*a, run=3))
    docs = made(spark, list(awkward) + [(k // 2, words(3, k)) for k in range(90)], [(900, None, "one", None, None), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1)])
    rows = [r.asDict() for r in docs.collect()]
    found = merkle.manifest(docs.withColumn("leaf", F.lit("clash")).withColumn("proof", F.lit(1)).repartition(5), arity=arity)
    assert found.columns == ["doc_id", "lang", "leaf", "claim", "place", "size", "group_place", "groups", "subroot", "root", "proof"]
    out = merkle.verify(found, arity).collect()
    got = [(r["doc_id"], r["lang"], bytes(r["leaf"]), r["place"], r["size"], r["group_place"], r["groups"], bytes(r["subroot"]), bytes(r["root"]), [bytes(d) for d in r["proof"]]) for r in out]
    assert sorted(got, key=repr) == sorted(brute(rows, arity), key=repr)
    assert all(r["verified"] and r["folded_root"] == r["root"] and r["claim"] == r["leaf"] for r in out)


def test_claims_that_differ_are_found(spark):
    docs = table(spark, [(k, words(3, k)) for k in range(20)])
    claim = F.when(F.col("doc_id") == 5, merkle.leaf_digest(F.lit(1)))
    out = merkle.verify(merkle.manifest(docs, claim=claim)).collect()
    assert [r["doc_id"] for r in out if not r["verified"]] == [5]


def test_one_and_none(spark):
    assert merkle.verify(merkle.manifest(table(spark, []))).collect() == []
    (r,) = merkle.verify(merkle.manifest(table(spark, [(1, "x")]))).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof"] == [] and r["verified"]


def test_equal_rows_are_dealt_to_several_tasks(spark):
    docs = spark.range(4000).select(F.lit("a").alias("grp"), F.struct(F.lit(1).alias("x")).alias("payload"), runs.tie().alias("tie"))
    packed = runs.pack_runs(docs, ["payload.x", "tie"], "struct<x:int>", run=100)
    placed = runs.places(packed).orderBy("part", "run").collect()
    assert len({r["part"] for r in placed}) >= 3 and [r["number"] for r in placed] == list(range(len(placed)))
    assert placed[0]["first"] == 0 and all(r["size"] == 4000 for r in placed)

"""Exact search by inner product against plain Python."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import inner_products as ip

SCHEMA = "vec_id long, embedding array<double>, score string"
_LONG = 2**63 - 1


def brute(rows, asked, k, scale=64.0):
    def usable(rows):
        best = {}
        for i, v in rows:
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
                own = [math.floor(max(-1.7e308, min(1.7e308, scale * x))) for x in v]
                best[i] = max(own, best.get(i, own))
        return best

    vectors, out = usable(rows), []
    for q, x in usable(asked).items():
        scores = [(-max(-_LONG, min(_LONG, sum(a * b for a, b in zip(x, v, strict=True)))), i) for i, v in vectors.items() if i != q and len(v) == len(x)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, rows, asked, k, **options):
    frame = lambda r: spark.createDataFrame([(i, v, "clash") for i, v in r], SCHEMA)
    out = ip.top_products(frame(rows).repartition(3), frame(asked), k, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in out.collect())


def test_search(spark, rng, monkeypatch):
    for name, n in (("VECTORS", 40), ("QUERIES", 8), ("TILE", 16), ("HEAD", 30), ("STEPS", 3)):
        monkeypatch.setattr(ip, name, n)
    x = rng.normal(size=(500, 6)) * rng.gamma(1, 1, size=(500, 1)) * [3, 1, 1, 0.3, 0.1, 0.1]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(600 + k, rows[3][1]) for k in range(150)]  # many equal vectors: ties by id
    assert found(spark, rows, rows[::20], 20) == brute(rows, rows[::20], 20)


def test_awkward_rows(spark, rng):
    some = [(k, rng.normal(size=3).tolist()) for k in range(30)]
    odd = [(100, None), (101, [1.0, None, 0.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 1.0]), (None, [1.0, 2.0, 3.0]), (104, [0.0, 0.0, 0.0]), (105, []), (106, []), (107, [2.0]), (108, [0.5]), (3, [9.0, 9.0, 9.0]), some[4], some[4]]
    huge = [(200, [1e300, -1e300, 1.0]), (201, [1e10, 1e10, 3.0]), (202, [1e308, 0.0, 0.0])]
    rows = some + odd
    assert found(spark, rows, rows, 5) == brute(rows, rows, 5)
    rows += huge
    assert found(spark, rows, rows, 40) == brute(rows, rows, 40)


def test_nothing(spark):
    assert found(spark, [], [], 3) == [] == found(spark, [(1, [1.0])], [], 3) == found(spark, [(1, [1.0])], [(1, [1.0])], 3)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 5), st.integers(0, 10_000), st.booleans())
def test_bounds_lose_nothing(n, m, k, seed, ties):
    """Blocks in any rotation: all that belongs to the k best is there."""
    r = np.random.default_rng(seed)
    top = 3 if ties else 500
    v, q = np.floor(r.normal(size=(n, 4)) * top), np.floor(r.normal(size=(m, 4)) * top)
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    ids, names = r.permutation(n) + 10, r.permutation(m) + 5
    turn, first = ip.rotation(ip._gram(v).tobytes(), 4)
    best = ip.Best(m, k)
    old, ip.TILE = ip.TILE, 7
    try:
        ip.search_block(best, q, names, v, ids, turn, first)
    finally:
        ip.TILE = old
    expected = sorted((j, -s, i) for j in range(m) for s, i in sorted((-int(s), int(i)) for s, i in zip(v @ q[j], ids, strict=True) if i != names[j])[:k])
    assert sorted(zip(best.row.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == sorted((j, s, i) for j, s, i in expected)


def test_bounds_exclude(rng):
    """Few vectors are multiplied out: the longest give floors that short ones don't reach."""
    v = np.floor(rng.normal(size=(20_000, 16)) * np.linspace(4, 0.05, 16) * rng.gamma(0.5, 20, size=(20_000, 1)))
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    turn, first = ip.rotation(ip._gram(v).tobytes(), 16)
    seen = []
    best = ip.Best(50, 10)
    add = best.add
    best.add = lambda row, ids, score: (seen.append(len(row)), add(row, ids, score))
    ip.search_block(best, v[100:5100:100], np.arange(50) + 10**6, v, np.arange(len(v)), turn, first)
    assert first < 16 and sum(seen) < 0.01 * 50 * len(v)


def test_scores_stay_exact():
    q = np.array([[2.0**40, 1.0]])
    assert ip.exact_products(q, np.array([[2.0**20, 1.0]]), 2.0**60).tolist() == [2**60 + 1]
    assert ip.exact_products(q, np.array([[2.0**40, 1.0]]), 2.0**80).tolist() == [_LONG]

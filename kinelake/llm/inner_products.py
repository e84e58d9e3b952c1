"""Exact top-k search by inner product over vectors sorted by norm, pruned by Cauchy-Schwarz bounds on rotated residuals.

Vectors are integers. Sorted by descending norm they make blocks; a block of queries needs only the first of these, as the
product of norms bounds every later score. Within a block vectors and queries are rotated by the singular vectors of all
vectors, so that their first coordinates hold most of the products: the sum over these, and the product of the norms of
what is left, bound a score, and only vectors whose bound reaches the k-th score so far are multiplied out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import in_batches, stored
from kinelake.llm.runs import pack_runs, places

#: Rows of a block of vectors, of a block of queries, of the tiles that are compared at a time, and of the longest that all queries meet first.
VECTORS, QUERIES, TILE, HEAD = 5000, 1024, 1024, 1024
#: Norms of blocks that a block of queries chooses its last block by, at most.
STEPS = 256
#: Share of the vectors' squared length that the first coordinates hold.
SHARE = 0.8
#: Largest bound of a product that doubles hold exactly; beyond it scores are made of Python's integers.
EXACT = 2.0**53
_LONG = 2**63 - 1


@dataclass
class NormIndex:
    """blocks: width, number, ids, ints (bytes), norms descend by number; heads: a row per width: the longest vectors, products of coordinates and some blocks' norms."""

    blocks: DataFrame
    heads: DataFrame


def integers(vectors: DataFrame, scale: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows vec_id, ints (floor(scale * x) of each component, as doubles) of the usable rows, one per id (of several the greatest)."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    finite = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    floors = finite.select("vec_id", F.transform("x", lambda v: _floor(v * F.lit(float(scale)))).alias("ints"))
    bounded = floors.select("vec_id", F.transform("ints", lambda v: F.least(F.greatest(v, F.lit(-1.7e308)), F.lit(1.7e308))).alias("ints"))
    return bounded.groupBy("vec_id").agg(F.max("ints").alias("ints"))


def _floor(v):
    """floor as a double; doubles from 2^52 on have no fraction."""
    return F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow."""
    top = np.abs(x).max(axis=1, initial=0)
    unit = x / np.where(top > 0, top, 1)[:, None]
    return top * np.sqrt(np.einsum("nd,nd->n", unit, unit))


def build(rows: DataFrame) -> NormIndex:
    """The index of rows (vec_id, ints): blocks of descending norm for each length of vectors, and a rotation for each."""
    unit = F.when(F.col("top") > 0, F.col("top"))
    norm = F.col("top") * F.sqrt(F.aggregate("ints", F.lit(0.0), lambda s, v: s + F.pow(v / unit, F.lit(2.0))))
    top = F.coalesce(F.array_max(F.transform("ints", lambda v: F.abs(v))), F.lit(0.0))
    sized = rows.withColumn("top", top).withColumn("norm", F.coalesce(norm, F.lit(0.0)))
    sized = sized.select(F.lpad(F.size("ints").cast("string"), 10, "0").alias("grp"), F.struct("vec_id", "ints").alias("payload"), "norm", "vec_id")
    runs = pack_runs(sized, [F.desc("norm"), "vec_id"], "struct<vec_id:long,ints:array<double>>", run=VECTORS)
    placed = stored(places(runs), "places")

    def block(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(2)[k].values
                ids = rows.field("vec_id").to_numpy()
                x = _matrix(rows.field("ints"), len(ids))
                norms = _norms(x)
                gram = _gram(x)
                yield pa.record_batch([pa.array([x.shape[1]]), batch.column(1).slice(k, 1), pa.array([len(ids)]), pa.array([norms.max(initial=0)]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([gram.tobytes()], pa.binary())], names=["width", "number", "n", "norm", "ids", "ints", "gram"])

    # Grams are of a width's size squared; they are summed by some tasks for a width, then by one.
    made = stored(runs.join(placed, ["part", "run", "grp"]).select("grp", "number", "rows").transform(in_batches, block, "width long, number long, n long, norm double, ids binary, ints binary, gram binary"), "blocks", 16 << 20)
    part = made.select("width", F.pmod(F.xxhash64("number"), F.lit(64)).alias("salt"), "gram")
    sums = part.groupBy("width", "salt").applyInArrow(_added, "width long, salt long, gram binary").groupBy("width").applyInArrow(_added, "width long, salt long, gram binary")
    last = made.groupBy("width").agg((F.max("number") + 1).alias("blocks"))
    some = made.select("width", "number", "norm").join(last, "width").filter(F.col("number") % F.ceil(F.col("blocks") / STEPS) == 0)
    steps = some.groupBy("width", "blocks").agg(F.array_sort(F.collect_list(F.struct("number", "norm"))).alias("steps"))  # STEPS at most
    longest = made.filter("number = 0").select("width", F.substr("ids", F.lit(1), F.lit(8 * HEAD)).alias("ids"), F.substr("ints", F.lit(1), (F.col("width") * (8 * HEAD)).cast("int")).alias("ints"))
    heads = sums.select("width", "gram").join(steps, "width").join(longest, "width")
    return NormIndex(made.drop("gram"), stored(heads, "heads", 16 << 20))


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def _gram(x: np.ndarray) -> np.ndarray:
    """Products of coordinates, of vectors brought to a common range, as only directions matter."""
    top = np.abs(x).max(initial=0)
    with np.errstate(over="ignore", under="ignore"):
        y = x / top if top > 1e100 else x
    return y.T @ y


def _added(table: pa.Table) -> pa.Table:
    total = None
    for g in table.column("gram"):
        own = np.frombuffer(g.as_py(), np.float64)
        total = own.copy() if total is None else total + own
    return pa.table({"width": table.column("width")[:1], "salt": pa.array([0], pa.int64()), "gram": pa.array([total.tobytes()], pa.binary())})


def rotation(gram: bytes, width: int) -> tuple[np.ndarray, int]:
    """The right singular vectors of all vectors, greatest value first, and how many of them hold SHARE of the squared length."""
    values, directions = np.linalg.eigh(np.frombuffer(gram, np.float64).reshape(width, width)) if width else (np.zeros(0), np.zeros((0, 0)))
    values, directions = np.maximum(values[::-1], 0), directions[:, ::-1]
    total = np.cumsum(values)
    first = int(np.searchsorted(total, SHARE * total[-1]) + 1) if width and total[-1] > 0 else width
    return np.ascontiguousarray(directions), min(first, width)


class Best:
    """The k best of each query so far: greatest score first, then least id. Scores are exact; ``floor`` is the k-th, or -inf."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.row, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.floor = np.full(queries, -np.inf) if floor is None else floor.copy()

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray):
        row, ids, score = (np.concatenate(x) for x in ((self.row, row), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last].astype(np.float64))
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]


def exact_products(q: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of pairs of integer rows, kept within 64 bits: where their norms' product allows it in doubles, which are exact then."""
    if bound < EXACT:
        return np.einsum("nd,nd->n", q, v).astype(np.int64)
    out = np.empty(len(q), np.int64)
    for k in range(len(q)):
        out[k] = max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(q[k], v[k], strict=True))))
    return out


def search_block(best: Best, asked: np.ndarray, names: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, first: int) -> None:
    """Bring ``best`` up to date with a block's vectors, which descend by norm, a tile at a time."""
    q_norm, v_norm = _norms(asked), _norms(vectors)
    with np.errstate(over="ignore", invalid="ignore"):
        q_turned, v_turned = asked @ turn, vectors @ turn
        plain = (q_norm.max(initial=0) * v_norm.max(initial=0)) < EXACT
        q_rest, v_rest = _norms(q_turned[:, first:]), _norms(v_turned[:, first:])
    for s in range(0, len(vectors), TILE):
        part = slice(s, s + TILE)
        # Lengths descend: a query that the tile's first can't serve is served by none after it.
        with np.errstate(over="ignore", invalid="ignore"):
            live = np.flatnonzero(~(_above(q_norm * v_norm[s]) < best.floor))
            if not len(live):
                break
            if plain:
                bound = q_turned[live, :first] @ v_turned[part, :first].T + q_rest[live, None] * v_rest[None, part]
                bound += 1e-9 * (q_norm[live, None] * v_norm[None, part] + 1)  # rounding of the rotated coordinates
            else:  # no rotated sums: they may not be finite
                bound = _above(q_norm[live, None] * v_norm[None, part])
        bound[names[live, None] == ids[None, part]] = np.nan
        may = bound >= best.floor[live, None]
        if may.mean() > 0.05 and plain:  # many are left: multiply all out at once, and raise the floors by the k-th
            scores = asked[live] @ vectors[part].T
            scores[~may] = -np.inf
            if scores.shape[1] >= best.k:
                kth = -np.partition(-scores, best.k - 1, axis=1)[:, best.k - 1]
                best.floor[live] = np.maximum(best.floor[live], kth)
            row, column = np.nonzero(may & (scores >= best.floor[live, None]))
            best.add(live[row], ids[part][column], scores[row, column].astype(np.int64))
        else:
            row, column = np.nonzero(may)
            if len(row):
                best.add(live[row], ids[part][column], exact_products(asked[live[row]], vectors[s + column], float(q_norm.max() * v_norm[s])))


def _above(bound: np.ndarray) -> np.ndarray:
    """A bound with room for rounding; one that isn't a number excludes nothing."""
    return np.nan_to_num(bound * (1 + 1e-9) + 1, nan=np.inf, posinf=np.inf)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k greatest inner products of each query (vec_id, embedding) with all other rows of vectors (vec_id, embedding).

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id, score (long), greatest score first, ties
    by the smaller vec_id; all candidates, if there are fewer than k. A candidate with the query's id is no answer.

    First each block of queries meets the longest vectors, which give it floors; then the blocks of vectors whose norms
    can reach these. Every pair of blocks is searched whole; each gives k rows a query at most.

    Rows with null ids or vectors, or with null or non-finite components, take no part; zero vectors do, with score 0;
    queries meet vectors of their own length only. Of rows with one id the greatest vector counts, so repeated rows
    count once. Scores beyond 64 bits become the greatest or least number there is. Empty tables give no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    index = build(stored(integers(vectors, scale), "integers"))
    asked = stored(integers(queries, scale), "asked")
    n = asked.count()
    salt = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, -(-n // QUERIES))))
    groups = asked.withColumn("width", F.size("ints").cast("long")).groupBy("width", salt.alias("block"))
    blocks = groups.agg(F.sort_array(F.collect_list(F.struct("vec_id", "ints"))).alias("queries"))  # some times QUERIES at most
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.withColumn("salt", F.pmod(F.col("block"), F.lit(parts)))
    copies = index.heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    begun = dealt.join(copies, ["width", "salt"]).select("width", "block", "queries", "gram", "blocks", "steps", "ids", "ints")

    def begin(batches):
        for batch in batches:
            for row in _rows(batch):
                names, q = _asked(row["queries"], row["width"])
                best = Best(len(names), k)
                turn, first = rotation(row["gram"], row["width"])
                ids = np.frombuffer(row["ids"], np.int64)
                search_block(best, q, names, np.frombuffer(row["ints"], np.float64).reshape(len(ids), -1), ids, turn, first)
                norms = _norms(q)
                with np.errstate(over="ignore", invalid="ignore"):
                    wanted = [_above(norms * x["norm"]) for x in row["steps"]]
                reach = [j for j, w in enumerate(wanted) if (w >= best.floor).any()]
                after = row["steps"][reach[-1] + 1]["number"] if reach and reach[-1] + 1 < len(row["steps"]) else row["blocks"]
                columns = [pa.array([row["width"]]), pa.array([row["block"]]), pa.array([after if reach else 0], pa.int64())]
                columns += [pa.array([x], pa.binary()) for x in (names.tobytes(), q.tobytes(), best.floor.tobytes(), turn.tobytes())]
                yield pa.record_batch([*columns, pa.array([first])], names=["width", "block", "last", "names", "asked", "floor", "turn", "first"])

    started = stored(begun.transform(in_batches, begin, "width long, block long, last long, names binary, asked binary, floor binary, turn binary, first long"), "begun", 16 << 20)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1))
    # Dealt by number of partitions rather than by size: little data is much work here.
    wanted = started.filter("last > 0").withColumn("number", numbers).repartition(parts, "width", "number")
    pairs = wanted.join(index.blocks.select("width", "number", "ids", "ints").repartition(parts, "width", "number"), ["width", "number"])

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                names, ids = np.frombuffer(row["names"], np.int64), np.frombuffer(row["ids"], np.int64)
                width = row["width"]
                best = Best(len(names), k, np.frombuffer(row["floor"], np.float64))
                shaped = [np.frombuffer(row[c], np.float64).reshape(m, width) for c, m in (("asked", len(names)), ("ints", len(ids)), ("turn", width))]
                search_block(best, shaped[0], names, shaped[1], ids, shaped[2], row["first"])
                yield pa.record_batch([pa.array(names[best.row]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    found = pairs.select("width", "names", "asked", "floor", "turn", "first", "ids", "ints").transform(in_batches, run, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield {name: batch.column(c)[k].as_py() if name != "queries" else batch.column(c)[k].values for c, name in enumerate(batch.schema.names)}


def _asked(rows: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("vec_id").to_numpy()
    return ids, _matrix(rows.field("ints"), len(ids)).reshape(len(ids), width)

"""Approximate nearest neighbours by inner product: NN-descent graphs and greedy graph search."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import discard, free_shuffles, in_batches, stored

#: Distinct vectors of a shard, about. A shard's graph and vectors are what one search task holds in memory.
SHARD_VECTORS = 16_384
#: Queries that go through a shard at a time, and pairs of a block and a shard that are made if queries allow it.
STEP, TASKS = 256, 1024


@dataclass
class GraphIndex:
    """nodes: shard, node, vec (float64 bytes); members: node, vec_id (its ``keep`` least ids); packed: a row per shard."""

    nodes: DataFrame
    members: DataFrame
    packed: DataFrame
    width: int
    keep: int


def usable(vectors: DataFrame) -> DataFrame:
    """The distinct rows (vec_id, embedding) with an id and a finite, non-zero embedding of the most frequent length."""
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    size = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.filter(F.size("embedding") == (size["n"] if size else 0)).distinct()


def build_graph(vectors: DataFrame, k: int = 24, sample: int = 12, rounds: int = 6, keep: int = 21, offer: int = 6) -> GraphIndex:
    """A graph of ``k`` near neighbours of every distinct vector of vectors (vec_id, embedding), by NN-descent.

    Equal vectors are one node, whose ``keep`` least ids are kept for answers. Nodes are dealt by hash into shards of
    bounded size, which have graphs of their own. A graph begins at random; in each round a node gathers ``sample`` of its
    neighbours and ``sample`` of the nodes that it is a neighbour of, by joins, with their vectors in 8 bits, and offers
    each of these the ``offer`` nearest of the others; windows keep the best ``k``. Vectors get one more coordinate that
    makes their norms equal, so that inner products order them as distances do.

    Rows without id, and vectors that are null, zero, of another length, or hold null or non-finite numbers are left
    out. Repeated rows count once. An empty table gives an empty index.
    """
    rows = stored(usable(vectors), "vectors")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    least = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = salted.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= keep).withColumn("r", F.row_number().over(least)).filter(F.col("r") <= keep)
    ranked = stored(ranked.select("vec_id", "embedding", "r").withColumn("node", F.min("vec_id").over(Window.partitionBy("embedding"))), "members")
    heads = ranked.filter("r = 1")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    stats = heads.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("embedding")).alias("width")).first()
    n, top, width = stats["n"], stats["top"] or 0.0, stats["width"] or 0
    shards = max(1, -(-n // SHARD_VECTORS))
    place = Window.partitionBy("shard").orderBy(F.xxhash64("node", F.lit(7)), "node")
    sizes = Window.partitionBy("shard")

    def to_bytes(batches):
        for batch in batches:
            x = np.array(batch.column(2).values.to_numpy(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, width))
            more = np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))
            code = np.clip(np.rint(np.column_stack([x, more]) * (127 / math.sqrt(top or 1))), -127, 127).astype(np.int8)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())], names=["shard", "node", "vec", "code"])

    coded = heads.select(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), "node", "embedding").transform(in_batches, to_bytes, "shard long, node long, vec binary, code binary")
    nodes = stored(coded.withColumn("place", F.row_number().over(place) - 1).withColumn("size", F.count("*").over(sizes)), "nodes")
    # The random beginning: the j-th neighbour of the node at place p is at a multiple of p plus a step.
    steps = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.pmod(F.col("place") + F.pmod(F.xxhash64("node", j), F.col("size") - 1) + 1, F.col("size")))
    begin = nodes.filter("size > 1").select("shard", F.col("node").alias("a"), F.explode(steps).alias("place")).join(nodes.select("shard", "place", F.col("node").alias("b")), ["shard", "place"])
    graph = stored(begin.filter("a != b").select("a", "b", F.lit(-1e9).cast("float").alias("sim")).distinct(), "graph")
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    codes = nodes.select(F.col("node").alias("u"), "code")

    def local(batches):
        for batch in batches:
            yield _offers(batch, offer)

    for turn in range(rounds):
        pick = lambda own: Window.partitionBy(own).orderBy(F.xxhash64(F.col("a"), F.col("b"), F.lit(turn)))  # noqa: E731, B023
        ahead = graph.withColumn("r", F.row_number().over(pick("a"))).filter(F.col("r") <= sample).select(F.col("a").alias("v"), F.col("b").alias("u"))
        behind = graph.withColumn("r", F.row_number().over(pick("b"))).filter(F.col("r") <= sample).select(F.col("b").alias("v"), F.col("a").alias("u"))
        worst = graph.groupBy(F.col("a").alias("u")).agg(F.min("sim").alias("worst"))
        around = ahead.union(behind).distinct().join(codes.join(worst, "u"), "u")
        own = codes.join(worst, "u").select(F.col("u").alias("v"), "u", "code", "worst")
        lists = around.select("v", "u", "code", "worst").union(own).groupBy("v").agg(F.collect_list(F.struct("u", "code", "worst")).alias("around"))
        found = lists.select("around").transform(in_batches, local, "a long, b long, sim float")
        merged = graph.union(found).groupBy("a", "b").agg(F.max("sim").alias("sim"))
        last, graph = graph, stored(merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"), "graph")
        discard(last)
        free_shuffles(vectors.sparkSession)
    back = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
    reverse = graph.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= k).select(F.col("b").alias("a"), F.col("a").alias("b"))
    linked = graph.select("a", "b").union(reverse).distinct().groupBy("a").agg(F.collect_list("b").alias("near"))
    full = nodes.select("shard", "node", "vec").join(linked.withColumnRenamed("a", "node"), "node", "left")
    packed = stored(full.groupBy("shard").applyInArrow(_pack, "shard long, ids binary, vecs binary, links binary, degree int"), "shards", 16 << 20)
    discard(rows, graph)
    return GraphIndex(nodes.select("shard", "node", "vec"), ranked.select("node", "vec_id"), packed, width, keep)


def _offers(batch: pa.RecordBatch, offer: int) -> pa.RecordBatch:
    """For each gathered node the nearest of the others in its list, if they beat its worst neighbour."""
    lists = batch.column(0)
    bounds = np.asarray(lists.offsets, np.int64)
    values = lists.values
    node = values.field("u").to_numpy()
    worst = values.field("worst").to_numpy()
    code = np.frombuffer(b"".join(c.as_py() for c in values.field("code")), np.int8).reshape(len(node), -1) if len(node) else np.zeros((0, 1), np.int8)
    out = []
    sizes = np.diff(bounds)
    for m in np.unique(sizes).tolist():
        if m < 2:
            continue
        at = bounds[:-1][sizes == m][:, None] + np.arange(m)
        for part in range(0, len(at), 512):
            rows = at[part : part + 512]
            x = code[rows].astype(np.float32)
            sim = x @ x.transpose(0, 2, 1)
            sim[:, np.arange(m), np.arange(m)] = -np.inf
            top = min(offer, m - 1)
            best = np.argpartition(-sim, top - 1, axis=2)[:, :, :top]
            value = np.take_along_axis(sim, best, axis=2)
            a = np.broadcast_to(rows[:, :, None], best.shape)
            b = np.take_along_axis(np.broadcast_to(rows[:, None, :], sim.shape), best, axis=2)
            good = value > worst[a]
            out.append((node[a[good]], node[b[good]], value[good]))
    a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    keep = a != b
    return pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep].astype(np.float32))], names=["a", "b", "sim"])


def _pack(table: pa.Table) -> pa.Table:
    """One row for a shard: ids ascending, their vectors, and neighbours by place, filled up with the node itself."""
    table = table.combine_chunks().sort_by("node")
    ids = table.column("node").to_numpy()
    near = table.column("near").to_pylist()
    degree = max([1, *(len(x) for x in near if x)])
    links = np.repeat(np.arange(len(ids), dtype=np.int32)[:, None], degree, axis=1)
    for k, x in enumerate(near):
        if x:
            links[k, : len(x)] = np.searchsorted(ids, x)
    vecs = np.frombuffer(b"".join(v.as_py() for v in table.column("vec")), np.float64)
    return pa.table({"shard": table.column("shard")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "vecs": pa.array([vecs.tobytes()], pa.binary()), "links": pa.array([links.tobytes()], pa.binary()), "degree": pa.array([degree], pa.int32())})


def greedy_search(vecs: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, expand: int = 8, entries: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` best nodes met, best first, and their inner products; missing ones are -1.

    A search begins at its start node (-1: none) and some fixed ones, and goes on from the best ``expand`` nodes of the
    beam that it hasn't gone on from, until there are none.
    """
    n, q = len(vecs), len(queries)
    few = vecs.astype(np.float32)
    asked = queries.astype(np.float32)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    first = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    ids = np.full((q, beam), n, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    new = np.concatenate([np.broadcast_to(first, (q, len(first))), np.where(start < 0, n, start)[:, None]], axis=1)
    active = np.arange(q)
    padded = np.vstack([few, np.zeros((1, few.shape[1]), np.float32)])
    near = np.vstack([links.astype(np.int64), np.full((1, links.shape[1]), n, np.int64)])
    while len(active):
        new = np.sort(new, axis=1)
        fresh = ~np.take_along_axis(seen[active], new, axis=1)
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        new = np.where(fresh, new, n)
        seen[active[:, None], new] = True
        value = np.einsum("qmd,qd->qm", padded[new], asked[active])
        value[new == n] = -np.inf
        all_ids = np.concatenate([ids[active], new], axis=1)
        all_sims = np.concatenate([sims[active], value], axis=1)
        all_done = np.concatenate([done[active], new == n], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_sims, all_done))
        order = np.where(done[active], np.inf, -sims[active])
        top = min(expand, beam - 1)
        chosen = np.argpartition(order, top, axis=1)[:, :top]
        open_ = ~np.take_along_axis(done[active], chosen, axis=1)
        from_ = np.where(open_, np.take_along_axis(ids[active], chosen, axis=1), n)
        done[active[:, None], chosen] = True
        going = open_.any(axis=1)
        new = near[from_[going]].reshape(int(going.sum()), from_.shape[1] * near.shape[1])
        active = active[going]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, axis=1)
    return np.where(ids == n, -1, ids), np.take_along_axis(sims, order, axis=1)


def search(index: GraphIndex, queries: DataFrame, k: int = 20, beam: int = 320, block: int = 2048) -> DataFrame:
    """The k nearest found of each query (query_id, embedding), best first: query_id, rank, vec_id, score.

    ``k`` is less than the index's ``keep``. Blocks of queries, of ``block`` at most about, and smaller where there are
    few shards, meet each shard, which is dealt once for a block; they go through its graph by greedy search. The best ``k + 1`` nodes of all shards are put
    together, expanded to the ids of their equal vectors, and ranked by score (inner product of the original vectors in
    double precision), ties by the smaller id. A vector whose vec_id is the query_id is no answer. A query begins at its
    own node where its id is one. Unusable queries (see build_graph) and an empty index give no rows.
    """
    if k >= index.keep:
        raise ValueError(f"the index keeps {index.keep} ids of equal vectors; build it with keep > {k}")
    asked = usable(queries.select(F.col("query_id").alias("vec_id"), "embedding")).filter(F.size("embedding") == index.width)
    shards = index.packed.count()
    least = -(-TASKS // max(1, shards))  # blocks that keep a cluster busy, if there are so many queries
    n = asked.count()
    parts = F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit((1 << 30) / max(1, -(-n // block), min(least, -(-n // STEP))))).cast("long")
    homes = index.members.select("vec_id", F.col("node").alias("home"))
    grouped = asked.join(homes, "vec_id", "left").select("vec_id", "embedding", "home").withColumn("part", parts)
    blocks = grouped.groupBy("part").agg(F.collect_list(F.struct("vec_id", "home", "embedding")).alias("queries"))  # some times ``block`` queries at most
    pairs = _with_shards(blocks, index.packed)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                vecs = np.frombuffer(row["vecs"], np.float64).reshape(len(ids), -1)
                links = np.frombuffer(row["links"], np.int32).reshape(len(ids), -1)
                names = np.array([x["vec_id"] for x in row["queries"]], np.int64)
                home = np.array([-1 if x["home"] is None else x["home"] for x in row["queries"]], np.int64)
                q = np.array([x["embedding"] for x in row["queries"]], np.float64)
                at = np.minimum(np.searchsorted(ids, home), len(ids) - 1)
                start = np.where(ids[at] == home, at, -1)
                for s in range(0, len(q), STEP):  # a step's marks of what it has seen are a byte for each vector and query
                    found, _ = greedy_search(vecs, links, q[s : s + STEP], start[s : s + STEP], max(beam, k + 2))
                    found = found[:, : 2 * k + 2]
                    r, c = np.nonzero(found >= 0)
                    score = np.einsum("nd,nd->n", vecs[found[r, c]], q[s + r])
                    yield pa.record_batch([pa.array(names[s + r]), pa.array(ids[found[r, c]]), pa.array(score)], names=["query_id", "node", "score"])

    hits = pairs.transform(in_batches, run, "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    nodes = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    answers = nodes.join(index.members, "node").filter(F.col("vec_id") != F.col("query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_shards(blocks: DataFrame, packed: DataFrame) -> DataFrame:
    """Every block of queries beside every shard: blocks are repeated by shard number, and joined to the shard by it."""
    last = packed.agg(F.max("shard")).first()[0]
    number = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")) if last is not None else F.array().cast("array<long>")
    n = max(8, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.withColumn("shard", F.explode(number)).join(packed, "shard").repartition(n, "part", "shard")

"""Merkle manifest of a dataset: partial parents gather their children in the tasks that hold them, and only what stays open is dealt again.

A parent's arity follows from its level's size, so a task knows by itself when a parent has all its children; then it
emits the parent, which is a child of the next in turn. Parents that other tasks hold children of leave their children
as a frontier; frontiers are dealt by ever larger stretches of leaves until each group has one root. Proofs go the other
way: the root's path is empty, and each round hands its nodes' paths back to the tasks that emitted them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import in_batches, stored
from kinelake.llm.runs import pack_runs, places, tie

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves under a block of the first round after the runs, at least, and blocks of a round under one of the next.
SPAN, FAN = 1 << 22, 512
#: Leaves whose proofs are in one batch.
LEAVES = 512
_ITEM = "grp string, size long, level int, place long, digest binary, source long"
_ABOUT = "struct<subroot:binary,root:binary,place:long,groups:long>"
_PATH = f"grp string, source long, level int, place long, path array<binary>, about {_ABOUT}"


def parent_digest(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests, as hexadecimal text one after the other."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (binary) of a row's columns: ``-`` for null, else UTF-8 byte count, ``:`` and value, one after the other."""
    texts = [c.cast("string") for c in columns]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*marked).cast("binary"), 256))


class Parents:
    """The partial parents of a group of ``size`` leaves; children come in any order, each with its level and place."""

    def __init__(self, size: int, arity: int):
        self.arity = arity
        self.widths = [size]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // arity))
        self.top = len(self.widths) - 1
        self.open: dict[tuple[int, int], dict[int, bytes]] = {}
        self.closed: dict[tuple[int, int], list[bytes]] = {}
        self.root: bytes | None = None

    def add(self, level: int, place: int, digest: bytes):
        """Give a child to its parent; a parent whose last child it is goes to its own parent."""
        while level < self.top:
            parent = (level + 1, place // self.arity)
            children = self.open.setdefault(parent, {})
            children[place] = digest
            if len(children) < min(self.arity, self.widths[level] - parent[1] * self.arity):
                return
            del self.open[parent]
            own = self.closed[parent] = [children[k] for k in sorted(children)]
            (level, place), digest = parent, parent_digest(own)
        self.root = digest

    def frontier(self) -> list[tuple[int, int, bytes]]:
        """What other tasks need: children of open parents, or the root."""
        if self.root is not None:
            return [(self.top, 0, self.root)]
        return [(level - 1, place, digest) for (level, _), children in self.open.items() for place, digest in children.items()]

    def siblings(self, level: int, place: int) -> tuple[list[bytes], tuple[int, int]]:
        """The siblings of a node and its ancestors, from left to right and level by level, and the first ancestor that isn't closed here."""
        out = []
        while (own := self.closed.get((level + 1, place // self.arity))) is not None:
            k = place % self.arity
            out += own[:k] + own[k + 1 :]
            level, place = level + 1, place // self.arity
        return out, (level, place)


def fold(digest: bytes, place: int, size: int, proof: list[bytes], arity: int = 2) -> tuple[bytes, list[bytes]]:
    """The root of a tree of ``size`` leaves by one leaf, its place and its siblings; and the siblings that are left over."""
    while size > 1:
        first = place - place % arity
        others = min(arity, size - first) - 1
        siblings, proof = proof[:others], proof[others:]
        k = place - first
        digest = parent_digest([*siblings[:k], digest, *siblings[k:]])
        place, size = place // arity, -(-size // arity)
    return digest, proof


def _items(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    names = ["grp", "size", "level", "place", "digest", "source"]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _round(items: pa.Table, arity: int) -> Parents:
    parents = Parents(items.column("size")[0].as_py(), arity)
    for level, place, digest in zip(items.column("level").to_pylist(), items.column("place").to_pylist(), items.column("digest").to_pylist(), strict=True):
        parents.add(level, place, digest)
    return parents


class Forest:
    """Trees over the leaves of each group: ``leaves`` has grp, leaf (binary), payload (struct with the leaf in it) and the columns of ``order``."""

    def __init__(self, leaves: DataFrame, order: list, payload: str, arity: int):
        if arity < 2:
            raise ValueError("a parent has two children at least")
        self.arity = arity
        self.runs = pack_runs(leaves, order, payload)
        self.placed = stored(places(self.runs), "places")
        most = self.placed.agg(F.max("size")).first()[0] or 0
        keyed = self.runs.join(self.placed, ["part", "run", "grp"])
        self.keyed = keyed.withColumn("source", F.shiftleft("part", 32) + F.col("run"))
        items = self.keyed.select("grp", "first", "size", "source", F.transform("rows", lambda r: r["leaf"]).alias("leaves")).transform(in_batches, self._combine(), _ITEM)
        span = arity
        while span < SPAN:
            span *= arity
        fan = arity
        while fan < FAN:
            fan *= arity
        self.rounds: list[DataFrame] = []
        while True:
            leaf = F.col("place") * F.pow(F.lit(arity), "level").cast("long")
            block = F.floor(leaf / F.lit(span)).cast("long") if span < most else F.lit(0).cast("long")
            self.rounds.append(stored(items.withColumn("block", block), "frontier"))
            items = self.rounds[-1].groupBy("grp", "block").applyInArrow(self._again(), _ITEM)
            if span >= most:
                break
            span *= fan
        #: grp, level, digest of each group's root
        self.roots = stored(items.select("grp", "level", "digest"), "roots")

    def _combine(self):
        arity = self.arity

        def run(batches):
            for batch in batches:
                rows = []
                for grp, first, size, source, leaves in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    parents = Parents(size, arity)
                    for k, leaf in enumerate(leaves):
                        parents.add(0, first + k, leaf)
                    rows += [(grp, size, *x, source) for x in parents.frontier()]
                yield _items(rows)

        return run

    def _again(self):
        arity = self.arity

        def run(items: pa.Table) -> pa.Table:
            parents = _round(items, arity)
            grp, size, block = (items.column(c)[0].as_py() for c in ("grp", "size", "block"))
            return pa.Table.from_batches([_items([(grp, size, *x, block) for x in parents.frontier()])])

        return run

    def paths(self, roots: DataFrame) -> DataFrame:
        """Rows of _PATH for what the runs emitted, from the paths above each group's root: grp, path, about."""
        arity = self.arity
        kinds = pa.list_(pa.binary())
        about_kind = pa.struct([("subroot", pa.binary()), ("root", pa.binary()), ("place", pa.int64()), ("groups", pa.int64())])

        def back(items: pa.Table, above: pa.Table) -> pa.Table:
            names = ["grp", "source", "level", "place", "path", "about"]
            if not items.num_rows:
                return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int32(), pa.int64(), kinds, about_kind)], names=names)
            parents = _round(items, arity)
            known = {(level, place): path for level, place, path in zip(*(above.column(c).to_pylist() for c in ("level", "place", "path")), strict=True)}
            out = []
            for level, place in zip(items.column("level").to_pylist(), items.column("place").to_pylist(), strict=True):
                own, end = parents.siblings(level, place)
                out.append(own + known[end])
            about = above.column("about").combine_chunks().take(pa.array(np.zeros(len(out), np.int64)))
            return pa.table([items.column("grp"), items.column("source"), items.column("level"), items.column("place"), pa.array(out, kinds), about], names=names)

        zero = F.lit(0).cast("long")
        out = self.roots.select("grp", zero.alias("source"), "level", zero.alias("place")).join(roots, "grp").select("grp", "source", "level", "place", "path", "about")
        for items in reversed(self.rounds):
            out = items.groupBy("grp", "block").cogroup(out.groupBy("grp", "source")).applyInArrow(back, _PATH)
        return out

    def leaves(self, roots: DataFrame, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
        """A row per leaf: the payload's ``fields``, then place, size, about and proof (siblings up to the root of all)."""
        arity = self.arity
        runs = self.paths(roots).groupBy("source").agg(F.collect_list(F.struct("level", "place", "path")).alias("above"), F.first("about").alias("about"))  # few for a run
        joined = self.keyed.join(runs, "source").select("first", "size", "rows", "above", "about", "grp")

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    first, size = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    rows = batch.column(2)[k].values
                    leaves = rows.field("leaf").to_pylist()
                    known = {(x["level"], x["place"]): x["path"] for x in batch.column(3)[k].as_py()}
                    parents = Parents(size, arity)
                    for j, leaf in enumerate(leaves):
                        parents.add(0, first + j, leaf)
                    for a in range(0, len(leaves), LEAVES):
                        proofs = []
                        for j in range(a, min(a + LEAVES, len(leaves))):
                            own, end = parents.siblings(0, first + j)
                            proofs.append(own + known[end])
                        n = len(proofs)
                        columns = [rows.field(name).slice(a, n) for name in fields]
                        columns += [pa.array(first + a + np.arange(n)), pa.array(np.full(n, size)), batch.column(4).take(pa.array(np.full(n, k))), pa.array(proofs, pa.list_(pa.binary())), batch.column(5).take(pa.array(np.full(n, k)))]
                        yield pa.record_batch(columns, names=[*fields, "place", "size", "about", "proof", "grp"])

        return joined.transform(in_batches, run, f"{schema}, place long, size long, about {_ABOUT}, proof array<binary>, grp string")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", claim: Column | None = None, arity: int = 2) -> DataFrame:
    """A Merkle tree over the rows of docs: a row per leaf, with its proof.

    Leaves are digests of ``columns`` (see leaf_digest); those of a ``group`` ascend by ``order`` and have a tree, whose
    root is the group's subroot; the subroots, by group, have a tree again, whose root is that of the dataset. Every
    ``arity`` consecutive nodes of a level have a parent; the last ones of a level may be fewer, even one.

    Returns ``order`` (long), ``group`` (string), leaf, claim, place and size (in the group), group_place and groups, subroot,
    root, proof: siblings of the leaf and of its ancestors, from left to right, level by level; digests are binary.
    ``claim`` is the digest to check against the proof, if it isn't the leaf itself (see verify).

    Null values have a mark of their own; null groups and null ids come first; rows with one id are ordered by their
    leaves, equal rows are leaves beside each other; an only leaf is its group's subroot, and an only subroot the root; an
    empty table has no leaves; other columns of docs aren't covered, whatever their names. Texts are hashed where they
    lie; from there on rows are of fixed size.
    """
    leaf = leaf_digest(*(F.col(c) for c in columns))
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = stored(docs.select(F.col(order).cast("long").alias("id"), grp.alias("grp"), leaf.alias("leaf"), (leaf if claim is None else F.coalesce(claim, leaf)).alias("claim")), "leaves")
    trees = Forest(rows.select("grp", "id", F.struct("id", "leaf", "claim").alias("payload"), tie().alias("tie")), ["id", "payload.leaf", "tie"], "struct<id:long,leaf:binary,claim:binary>", arity)
    tops = trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), F.struct(F.col("grp").alias("own"), F.col("digest").alias("leaf")).alias("payload"))
    top = Forest(tops, ["own"], "struct<own:string,leaf:binary>", arity)
    nothing = F.array().cast("array<binary>")
    zero = F.lit(0).cast("long")
    root = top.roots.select("grp", nothing.alias("path"), F.struct(F.col("digest").alias("subroot"), F.col("digest").alias("root"), zero.alias("place"), zero.alias("groups")).cast(_ABOUT).alias("about"))
    subroots = top.leaves(root, {"own": pa.string(), "leaf": pa.binary()}, "own string, leaf binary")
    about = F.struct(F.col("leaf").alias("subroot"), F.col("about.root").alias("root"), "place", F.col("size").alias("groups")).cast(_ABOUT)
    above = stored(subroots.select(F.col("own").alias("grp"), F.col("proof").alias("path"), about.alias("about")), "subroots")
    out = trees.leaves(above, {"id": pa.int64(), "leaf": pa.binary(), "claim": pa.binary()}, "id long, leaf binary, claim binary")
    own = F.when(F.col("grp") != "", F.substr("grp", F.lit(2)))
    return out.select(F.col("id").alias(order), own.alias(group), "leaf", "claim", "place", "size", F.col("about.place").alias("group_place"), F.col("about.groups").alias("groups"), F.col("about.subroot").alias("subroot"), F.col("about.root").alias("root"), "proof")


def verify(leaves: DataFrame, arity: int = 2) -> DataFrame:
    """A manifest's rows with folded_root, made of the claim and the proof alone, and verified: whether it is the root."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in leaves.schema)}, folded_root binary"

    def run(batches):
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("claim", "place", "size", "group_place", "groups", "proof"))
            out = []
            for claim, place, size, group_place, groups, proof in zip(*columns, strict=True):
                subroot, rest = fold(claim, place, size, proof, arity)
                out.append(fold(subroot, group_place, groups, rest, arity)[0])
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "folded_root"])

    return leaves.transform(in_batches, run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))

"""N-gram Jaccard join by count vectors of hashed token groups in R-trees.

A document's distinct shingles are hashed into groups, whose counts are a point. Documents that may be similar are first
dealt into cells, of which two similar sets share one, so that no pair is lost. For high thresholds a cell's key is all
of a group's elements: with more groups than two similar sets can differ in elements, one group is the same in both. For
lower ones it is an element: all sets are ordered alike, rare shingles first, and two similar sets share one of their
first, (1 - t) of the set and one more. Within a cell R-trees over the points bound the overlap of nodes and points by
sums of coordinate minima. What the bounds can't exclude is verified on whole sets, in the task that finds it, and only
edges that link different components leave that task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import FILTER_BITS, LOWER, bit_filter, byte_class, discard, free_shuffles, in_batches, maybe, mix, ragged, stored, text_blocks, word_hashes, word_spans
from kinelake.llm.graph import components

WORD = byte_class(lambda b: b not in (9, 10, 11, 12, 13, 32))
#: Coordinates of a point, and the greatest value of one; points beyond it are this value throughout.
GROUPS, FULL = 512, 127
#: Points of an R-tree's node, and of a block of a large cell.
FANOUT, BLOCK = 16, 2048
#: Elements of the sets of a block, about, and coordinates of the points that are made of whole sets in a task.
ELEMENTS, FINE = 1 << 21, 4096
#: Bins that count shingles by their first bits, and those of a chunk that is summed by itself.
BIN_BITS, CHUNK = 22, 1 << 14
_A, _B, _C, _D = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
#: The least threshold from which cells are whole groups of elements; below, groups would have two elements or three.
BY_GROUPS = 85


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int):
    """Number and shingle hashes, in order, of each text that has any."""
    low = LOWER[data]
    begin, end, first = word_spans(low, starts, ends, WORD)
    h = word_hashes(low, begin, end)
    factors = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(width)]
    for k in range(len(starts)):
        own = h[first[k] : first[k + 1]]
        if len(own) == 0:
            continue
        n = width if len(own) >= width else len(own)
        total = np.full(len(own) - n + 1, n, np.uint64)
        for j in range(n):
            total += own[j : j + len(total)] * factors[j]
        yield k, mix(total)


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and the sets' bounds."""
    out, sizes = [np.zeros(0, np.uint64)], np.zeros(len(starts), np.int64)
    for k, hashes in _shingles(data, starts, ends, width):
        out.append(np.unique(hashes))
        sizes[k] = len(out[-1])
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def _fingerprints(sets: np.ndarray, bounds: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A class number and a second number of each set: sums of scrambled elements. Sets are the same where both agree.

    Classes go by the first alone; jaccard_groups makes sure that no two sets share it, and else takes another salt.
    """
    sums = []
    for k in (_A + np.uint64(salt), _B):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ k), dtype=np.uint64)])
        sums.append(mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]


class Families:
    """Size classes and, for each, the number of groups that lets no similar pair pass unseen.

    Similar sets of sizes a <= b differ in at most (a + b) (1 - t) / (1 + t) elements. They meet in the family of b's
    class: sets of that class belong to it, and sets of the class below that can be similar to one of it.
    """

    def __init__(self, percent: int, ratio: float = 0.75):
        self.percent = percent
        self.lower = [1]
        while self.lower[-1] < 1 << 40:
            self.lower.append(max(self.lower[-1] + 1, int(self.lower[-1] / ratio)))
        self.lower_array = np.array(self.lower)
        most = self.lower_array[1:] - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        #: Two more than can differ: two groups agree, so that one of them isn't empty in sets with one empty group.
        self.groups = differ + 2

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (set, family), by set."""
        own = np.searchsorted(self.lower_array, sizes, "right") - 1
        sets, families = [np.flatnonzero(sizes > 0)], [own[sizes > 0]]
        step = 1
        while len(reach := np.flatnonzero((sizes > 0) & (100 * sizes >= self.percent * self.lower_array[np.minimum(own + step, len(self.lower) - 1)]))):
            sets.append(reach)
            families.append(own[reach] + step)
            step += 1
        s, f = np.concatenate(sets), np.concatenate(families)
        order = np.argsort(s, kind="stable")
        return s[order], f[order]


def group_cells(sets: np.ndarray, bounds: np.ndarray, families: Families) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each set, as 64-bit keys, and the keys' bounds: one for each group of its families, by the group's elements."""
    sizes = np.diff(bounds)
    owner, family = families.of(sizes)
    groups = families.groups[family]
    base = np.cumsum(groups) - groups
    length = sizes[owner]
    element = sets[ragged(bounds[owner], length)]
    which = np.repeat(np.arange(len(owner)), length)
    spread = mix(element ^ _C)
    place = base[which] + ((spread >> np.uint64(32)) * groups[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = int(groups.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, place, mix(element ^ _D))
    counts = np.bincount(place, minlength=total)
    row = np.repeat(np.arange(len(owner)), groups)
    number = np.arange(total) - base[row]
    keys = mix(sums + mix(family[row].astype(np.uint64) * _A + number.astype(np.uint64) * _B) + counts.astype(np.uint64))
    empty = counts == 0
    keep = ~empty | (np.bincount(row, weights=empty, minlength=len(owner))[row] >= 2)
    per_set = np.bincount(owner[row[keep]], minlength=len(sizes))
    return keys[keep], np.concatenate([[0], np.cumsum(per_set)])


def shingle_levels(docs: DataFrame, width: int) -> np.ndarray:
    """How common shingles are, by bins of their hashes: logarithms of the bins' counts over all documents.

    The table has the same size whatever the input's. It only sets the order of shingles, so it needn't be sharp: any
    order gives every pair its cell, and this one keeps passages that many documents share out of most sets' first.
    """

    def count(batches):
        total = np.zeros(1 << BIN_BITS, np.uint32)
        for batch in batches:
            for _, data, starts, ends in text_blocks(batch, "text"):
                for _, hashes in _shingles(data, starts, ends, width):
                    np.add.at(total, _bins(hashes), 1)
        chunks = np.minimum(total, 65535).astype("<u2").reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        yield pa.record_batch([pa.array(some), pa.array([zlib.compress(chunks[k], 1) for k in some.tolist()], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(raw), "<u2").astype(np.uint64)
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([np.log2(x + 1).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "levels"])

    counts = docs.select("text").transform(in_batches, count, "chunk long, counts binary")
    out = np.zeros((1 << BIN_BITS) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK)
    for r in counts.repartition("chunk").transform(in_batches, add, "chunk long, levels binary").collect():
        out[r["chunk"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def _bins(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def prefix_cells(sets: np.ndarray, bounds: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each set, as 64-bit keys, and the keys' bounds.

    Similar sets of a <= b elements share at least percent of b. So they share one of the first elements of each, in any
    order of all elements, where the first are those beyond that share and one more. A key is its element's place in the
    order: level, then hash.
    """
    order = levels[_bins(sets)].astype(np.uint64) << np.uint64(58) | sets >> np.uint64(6)
    sizes = np.diff(bounds)
    first = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
    out = [np.partition(order[s : s + n], k - 1)[:k] for s, n, k in zip(bounds[:-1].tolist(), sizes.tolist(), first.tolist(), strict=True) if n]
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum(first)])


def count_vectors(sets: np.ndarray, bounds: np.ndarray, groups: int) -> np.ndarray:
    """Counts of the sets' elements by group, as points."""
    n = len(bounds) - 1
    place = np.repeat(np.arange(n), np.diff(bounds)) * groups + (mix(sets ^ _B) % np.uint64(groups)).astype(np.int64)
    counts = np.bincount(place, minlength=n * groups).reshape(n, groups)
    counts[counts.max(axis=1) >= FULL] = FULL
    return counts.astype(np.uint8)


def enough(overlap, total, percent: int):
    """Whether sets of together ``total`` elements with that overlap are similar: 100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * total


def _may(a: np.ndarray, b: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether points or nodes may hold similar sets; where both are full their coordinates tell nothing."""
    bound = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return enough(bound, total, percent) | (bound == FULL * a.shape[1])


class RTree:
    """Points bulk-loaded in order of size and first coordinates; a node knows its greatest coordinates, sizes, and components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.levels = []
        high, small, large = points[self.order], sizes[self.order], sizes[self.order]
        low_c = high_c = component[self.order]
        while True:
            self.levels.append((high, small, large, low_c, high_c))
            if len(high) == 1:
                break
            at = np.arange(0, len(high), FANOUT)
            high, small, large = np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            low_c, high_c = np.minimum.reduceat(low_c, at), np.maximum.reduceat(high_c, at)

    def join(self, other: "RTree", percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points (by their numbers) of different components whose bound allows similarity; with itself each pair once."""
        same = self is other
        depth = max(len(self.levels), len(other.levels)) - 1
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth, -1, -1):
            if level < depth:
                a, b = self._children(a, b, other, level)
            keep = np.zeros(len(a), bool)
            for part in range(0, len(a), 1 << 14):
                x, y = a[part : part + (1 << 14)], b[part : part + (1 << 14)]
                h1, s1, l1, c1, d1 = (v[x] for v in self.levels[min(level, len(self.levels) - 1)])
                h2, s2, l2, c2, d2 = (v[y] for v in other.levels[min(level, len(other.levels) - 1)])
                near = (100 * l1 >= percent * s2) & (100 * l2 >= percent * s1) & ~((c1 == d1) & (c2 == d2) & (c1 == c2))
                near[near] = _may(h1[near], h2[near], (s1 + s2)[near], percent)
                keep[part : part + (1 << 14)] = near
            if same:
                keep &= a <= b if level else a < b
            a, b = a[keep], b[keep]
        return self.order[a], other.order[b]

    def _children(self, a: np.ndarray, b: np.ndarray, other: "RTree", level: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children at a level of node pairs of the level above; a tree that is less deep stays at its root."""

        def below(tree: RTree, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if level >= len(tree.levels) - 1:
                return node, np.ones(len(node), np.int64)
            first = node * FANOUT
            return first, np.minimum(first + FANOUT, len(tree.levels[level][0])) - first

        a0, na = below(self, a)
        b0, nb = below(other, b)
        row = np.repeat(np.arange(len(a)), na * nb)
        number = np.arange(len(row)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        return a0[row] + number // nb[row], b0[row] + number % nb[row]


def sketches(docs: DataFrame, percent: int, width: int, salt: int = 0, key: str | None = None) -> DataFrame:
    """A stored row per document (doc_id, text): row, doc_id, n, class, second (number of the set), point, cells, and the column ``key`` of docs, a long, if given."""
    by_groups = percent >= BY_GROUPS
    families = Families(percent)
    levels = docs.sparkSession.sparkContext.broadcast(None if by_groups else shingle_levels(docs, width))  # 4 MB, whatever the input
    carried = [key] if key else []

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, data, starts, ends in text_blocks(batch, "text"):
                sets, bounds = shingle_sets(data, starts, ends, width)
                keys, key_bounds = group_cells(sets, bounds, families) if by_groups else prefix_cells(sets, bounds, levels.value, percent)
                f1, f2 = _fingerprints(sets, bounds, salt)
                points = count_vectors(sets, bounds, GROUPS)
                n = len(starts)
                cells = pa.ListArray.from_arrays(pa.array(key_bounds, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.record_batch([pa.array(row + np.arange(n)), batch.column(0).slice(first, n), pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2), pa.array([p.tobytes() for p in points], pa.binary()), cells, *[batch.column(2).slice(first, n) for _ in carried]], names=["row", "doc_id", "n", "class", "second", "point", "cells", *carried])
                row += n

    schema = "row long, doc_id long, n long, class long, second long, point binary, cells array<long>" + "".join(f", {c} long" for c in carried)
    out = stored(docs.select(F.col("doc_id").cast("long"), "text", *carried).transform(in_batches, run, schema), "sketches", 32 << 20)
    levels.destroy()
    return out


def _cell_members(chosen: DataFrame) -> DataFrame:
    """cell, class, rank: the cells of two classes or more; rank is the share, in 255ths, of the class's cells that are such. chosen: class, cells.

    Cells are counted, which combines before they are dealt; then the few that are shared are found again by a filter
    of fixed size, and those it lets through are joined to them.
    """
    shared = stored(chosen.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell"), "shared")
    place = F.col("cell").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = chosen.sparkSession.sparkContext.broadcast(bit_filter(shared.select(place.alias("place"))))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            cells = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            keep = maybe(bits.value, cells & (FILTER_BITS - 1))
            rank = 255 * np.bincount(owner[keep], minlength=len(lists)) // np.maximum(1, np.bincount(owner, minlength=len(lists)))
            yield pa.record_batch([pa.array(cells[keep]), pa.array(batch.column(0).to_numpy()[owner[keep]]), pa.array(rank[owner[keep]])], names=["cell", "class", "rank"])

    some = chosen.select("class", "cells").transform(in_batches, run, "cell long, class long, rank long")
    out = stored(some.join(shared, "cell", "left_semi"), "cells")
    bits.destroy()
    discard(shared)
    return out


def _whole_sets(docs: DataFrame, classes: DataFrame, heads: DataFrame, width: int, salt: int) -> DataFrame:
    """class, set (elements of 8 bytes): the whole sets of these classes, stored; a class may come twice, and others with it.

    Only the documents that are needed are shingled again: filters of fixed size on doc_id and on the class find them.
    """
    wanted = stored(heads.join(classes.distinct(), "class").select("class", "doc_id"), "wanted")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    share = docs.sparkSession.sparkContext.broadcast
    by_id = share(bit_filter(wanted.select(place.alias("place"))))  # 16 MB each, whatever the input
    by_class = share(bit_filter(wanted.select(F.col("class").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("place"))))

    def again(batches):
        for batch in batches:
            rows = np.flatnonzero(maybe(by_id.value, batch.column(1).to_numpy()))
            if not len(rows):
                continue
            batch = batch.take(pa.array(rows))
            for _, data, starts, ends in text_blocks(batch, "text"):
                sets, bounds = shingle_sets(data, starts, ends, width)
                number, _ = _fingerprints(sets, bounds, salt)
                own = np.flatnonzero(maybe(by_class.value, number & (FILTER_BITS - 1)) & (np.diff(bounds) > 0))
                raw = [sets[bounds[k] : bounds[k + 1]].astype("<u8").tobytes() for k in own.tolist()]
                yield pa.record_batch([pa.array(number[own]), pa.array(raw, pa.binary())], names=["class", "set"])

    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).select("text", place.alias("place"))
    sets = stored(texts.transform(in_batches, again, "class long, set binary"), "sets", 32 << 20)
    by_id.destroy()
    by_class.destroy()
    discard(wanted)
    return sets


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    return bool(enough(len(np.intersect1d(s, t, assume_unique=True)), len(s) + len(t), percent))


def verified(docs: DataFrame, pairs: DataFrame, heads: DataFrame, percent: int, width: int, salt: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar, as stored edges."""
    sets = _whole_sets(docs, pairs.select(F.col("a").alias("class")).union(pairs.select("b")), heads, width, salt)

    def check(batches):
        for batch in batches:
            keep = [k for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)) if _similar(x.as_buffer(), y.as_buffer(), percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    with_a = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    out = stored(both.select("a", "b", "set_a", "set_b").transform(in_batches, check, "a long, b long"), "edges")
    discard(sets)
    return out


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, GROUPS)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points (class, n, point) allow similarity, stored."""

    def run(batches):
        for batch in batches:
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_may(_points(batch.column(2)), _points(batch.column(3)), total, percent)))

    with_a = pairs.join(points.select(F.col("class").alias("a"), F.col("point").alias("pa"), F.col("n").alias("na")), "a")
    both = with_a.join(points.select(F.col("class").alias("b"), F.col("point").alias("pb"), F.col("n").alias("nb")), "b")
    near = both.filter((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return stored(near.select("a", "b", "pa", "pb", "na", "nb").transform(in_batches, run, "a long, b long"), "pairs")


def _in_blocks(rows: DataFrame, group: str, find) -> DataFrame:
    """Edges (a, b) that ``find`` makes of the rows of each group (a long), which has a number of ``blocks``.

    Each pair of a group's blocks is dealt by itself, so that no task gathers a large group. find takes a table, with x
    and y (the pair) and own (a row's block), and the first rows of its pairs of blocks.
    """
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    others = [c for c in rows.columns if c not in (group, "blocks")]
    dealt = dealt.select(F.col(group).alias("group"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *others)
    key = ["group", "x", "y"]

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            k = [table.column(c).to_numpy() for c in key]
            new = np.flatnonzero(np.concatenate([[True], (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])]))
            rest = table.slice(new[-1])  # may go on in the next batch
            if len(new) > 1:
                yield from find(table.slice(0, new[-1]), new[:-1])
        if rest is not None and rest.num_rows:
            yield from find(rest, np.zeros(1, np.int64))

    return dealt.repartition(*key).sortWithinPartitions(*key).transform(in_batches, run, "a long, b long")


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which edges (a, b) span what they connect, and the labels of nodes then; a label is a node that has itself for label."""
    label, chosen, left = label.copy(), [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(chosen), label
        root, first = np.unique(np.maximum(x, y), return_index=True)
        chosen.append(left[first])
        label[root] = np.minimum(x, y)[first]
        while (label[label] != label).any():
            label = label[label]


def _edges(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])


def _within_cells(rows: DataFrame, percent: int) -> DataFrame:
    """Edges that span what the R-trees of cells can't rule out to be similar, between different components.

    Rows are cell, class, component, n, point, size (of the cell). A task's edges are fewer than its rows.
    """

    def find(table, first):
        node, component, n = (table.column(c).to_numpy() for c in ("class", "component", "n"))
        for a, b in _candidates(table, first, component, n, _points(table.column("point")), percent):
            chosen, _ = _spanning(np.arange(len(node)), a, b)
            yield _edges(node, a[chosen], b[chosen])

    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    return _in_blocks(rows.select("cell", "class", "component", "n", "point", blocks.alias("blocks")), "cell", find)


def _settled(docs: DataFrame, maybe: DataFrame, labels: DataFrame | None, heads: DataFrame, percent: int, width: int, salt: int) -> DataFrame:
    """Stored edges (a, b) that link, by whole sets, all that is similar of different components among what edges ``maybe`` connect.

    The classes that these connect are a family. A family's sets meet in the tasks of its pairs of blocks, once for each
    block; pairs that points allow are verified there until what they would link is linked.
    """
    families = components(maybe)
    sets = _whole_sets(docs, families.select(F.col("node").alias("class")), heads, width, salt)
    rows = families.select(F.col("node").alias("class"), F.col("component").alias("family")).join(sets.select("class", "set", (F.octet_length("set") / 8).cast("long").alias("n")), "class")
    known = rows.withColumn("component", F.col("class")) if labels is None else rows.join(labels.select(F.col("node").alias("class"), F.col("component").alias("c")), "class", "left").withColumn("component", F.coalesce("c", "class"))
    size = rows.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).cast("long").alias("blocks"))

    def find(table, first):
        node, component = (table.column(c).to_numpy() for c in ("class", "component"))
        raw = [x.as_buffer() for chunk in table.column("set").chunks for x in chunk]
        n = np.array([x.size // 8 for x in raw], np.int64)
        whole, bounds = np.frombuffer(b"".join(raw), "<u8"), np.concatenate([[0], np.cumsum(n)])
        points = count_vectors(whole, bounds, GROUPS)
        _, part = np.unique(component, return_inverse=True)
        label = np.arange(part.max() + 1)
        for a, b in _candidates(table, first, component, n, points, percent):
            for s in range(0, len(a), 1 << 10):
                near = slice(s, s + (1 << 10))
                a_, b_ = a[near], b[near]
                apart = label[part[a_]] != label[part[b_]]
                a_, b_ = _finer(raw, n, a_[apart], b_[apart], percent)
                while len(a_):
                    chosen, _ = _spanning(label, part[a_], part[b_])
                    chosen = np.sort(chosen)
                    good = chosen[[_similar(raw[a_[k]], raw[b_[k]], percent) for k in chosen.tolist()]]
                    yield _edges(node, a_[good], b_[good])
                    _, label = _spanning(label, part[a_[good]], part[b_[good]])
                    left = np.ones(len(a_), bool)
                    left[chosen] = False
                    left &= label[part[a_]] != label[part[b_]]
                    a_, b_ = a_[left], b_[left]

    dealt = known.join(size, "family").select("family", "blocks", "class", "component", "set")
    out = stored(_in_blocks(dealt, "family", find), "edges")
    discard(families, sets)
    return out


def _finer(raw: list, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that points of FINE coordinates, made of their sets, allow to be similar."""
    if not len(a):
        return a, b
    rows = np.unique(np.concatenate([a, b]))
    points = count_vectors(np.frombuffer(b"".join(raw[k] for k in rows.tolist()), "<u8"), np.concatenate([[0], np.cumsum(n[rows])]), FINE)
    x, y = np.searchsorted(rows, a), np.searchsorted(rows, b)
    keep = np.concatenate([_may(points[x[s : s + 256]], points[y[s : s + 256]], (n[a] + n[b])[s : s + 256], percent) for s in range(0, len(a), 256)])
    return a[keep], b[keep]


def _sharper(points: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows whose points allow similarity."""
    keep = np.zeros(len(a), bool)
    for part in range(0, len(a), 1 << 14):
        x, y = a[part : part + (1 << 14)], b[part : part + (1 << 14)]
        keep[part : part + (1 << 14)] = _may(points[x], points[y], n[x] + n[y], percent)
    return a[keep], b[keep]


def _candidates(table: pa.Table, first: np.ndarray, component: np.ndarray, n: np.ndarray, points: np.ndarray, percent: int):
    """Pairs of rows (a, b) of different components that points allow to be similar, by and by, of groups that begin at rows ``first``."""
    x, y, own = (table.column(c).to_numpy() for c in ("x", "y", "own"))
    half = points[:, : GROUPS // 2] + points[:, GROUPS // 2 :]  # fewer coordinates for most comparisons, all for what they let pass
    bounds = np.append(first, table.num_rows)
    size = np.diff(bounds)
    # Groups that fit one node of a tree: its points with each other, for all such groups at once.
    small = (size <= FANOUT) & (x[bounds[:-1]] == y[bounds[:-1]])
    of = np.repeat(np.arange(len(size)), size)
    for step in range(1, FANOUT):
        a = np.flatnonzero((of[:-step] == of[step:]) & small[of[:-step]]) if len(of) > step else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + step
        near = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (component[a] != component[b])
        a, b = _sharper(half, n, a[near], b[near], percent)
        yield _sharper(points, n, a, b, percent)
    for c in np.flatnonzero(~small).tolist():
        s = slice(bounds[c], bounds[c + 1])
        if x[s.start] == y[s.start]:
            tree = RTree(half[s], n[s], component[s])
            a, b = tree.join(tree, percent)
        else:
            p = np.flatnonzero(own[s] == x[s.start])
            q = np.flatnonzero(own[s] == y[s.start])
            if not len(p) or not len(q):
                continue
            a, b = RTree(half[s][p], n[s][p], component[s][p]).join(RTree(half[s][q], n[s][q], component[s][q]), percent)
            a, b = p[a], q[b]
        yield _sharper(points, n, s.start + a, s.start + b, percent)


def jaccard_groups(docs: DataFrame, percent: int = 80, width: int = 5, stars: int = 2, key: str | None = None) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_shingles, component_id, and if ``key`` is given this column of docs, a long, and component.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct runs of ``width``
    words, or all words as one where there are fewer. Documents link where 100 * overlap >= percent * union;
    component_id is the least doc_id reachable. Null and empty texts have empty sets and link with nothing, also not with
    each other. Repeated rows and equal sets are one class from the start. Null doc_ids stay, and take the component of
    their class. An empty table gives no rows; other columns are ignored. component tells groups apart that have no doc_id
    at all; it is null for empty sets.

    Each of ``stars`` rounds compares the classes of a cell with one of them, which joins large groups without their
    pairs. All cells choose by the same order, first by the share of a class's cells that others share too, which is
    largest in the middle of a group, then by chance; so a class meets few leaders in its many cells. R-trees then
    compare what is left of a cell in different components. All links between different components are verified on whole
    sets, so the components are exact.
    """
    spark = docs.sparkSession
    salt = 0
    while True:
        all_docs = sketches(docs, percent, width, salt, key)
        filled = all_docs.filter("n > 0")
        # A class is one set: its second number and size are the same in all rows.
        clash = filled.groupBy("class").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("second", "n") for f in (F.min, F.max)]).filter("min_second < max_second OR min_n < max_n")
        if clash.isEmpty():
            break
        discard(all_docs)
        salt += 1
    classes = stored(filled.groupBy("class").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "classes")
    # Copies are written first: Spark sends them to all tasks where they are few, and joins by shuffling where not.
    copies = stored(filled.select("row", "class").join(classes.withColumnRenamed("row", "first"), "class").filter(F.col("row") != F.col("first")).select("row"), "copies")
    chosen = filled.join(copies, "row", "left_anti")
    heads = chosen.select("class", "doc_id")
    points = chosen.select("class", "point", "n")
    members = _cell_members(chosen)
    free_shuffles(spark)
    labels = edges = None
    for turn in range(stars + 1):
        if labels is None:
            known = members.withColumn("component", F.col("class"))
        else:
            known = stored(members.join(labels.select(F.col("node").alias("class"), F.col("component").alias("c")), "class", "left").select("cell", "class", "rank", F.coalesce("c", "class").alias("component")), "members")
        order = [-F.col("rank")] if turn == 0 else []
        lead = F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate([*order, F.xxhash64(F.lit(turn), F.col("class"))])], F.col("class").alias("class"), F.col("component").alias("component")))
        split = known.groupBy("cell").agg(lead.alias("lead"), F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        if turn < stars:
            star = known.join(split.select("cell", F.col("lead.class").alias("leader"), F.col("lead.component").alias("of")), "cell").filter(F.col("component") != F.col("of"))
            near = stored(star.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct(), "stars")
            pairs = _bounded(near, points, percent)
            discard(near)
            new = None if pairs.isEmpty() else verified(docs, pairs, heads, percent, width, salt)
        else:
            rows = known.join(split.select("cell", "size"), "cell").join(points, "class")
            pairs = stored(_within_cells(rows, percent).distinct(), "maybe")
            new = None if pairs.isEmpty() else _settled(docs, pairs, labels, heads, percent, width, salt)
        if new is not None:
            edges = new if edges is None else edges.union(new)
            discard(labels)
            labels = components(edges)
        discard(known, pairs)
        free_shuffles(spark)
    carried = [key] if key else []
    named_class = ["component"] if key else []
    out = stored(all_docs.select("doc_id", "n", "class", *carried), "documents")  # all that the result reads later
    discard(members, copies, all_docs)
    empty = out.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *carried, *[F.lit(None).cast("long").alias(c) for c in named_class])
    if labels is None:
        of_class = classes.select("class", F.col("least").alias("component_id"), F.col("class").alias("component"))
    else:
        named = classes.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        of_class = named.join(least, "component").select("class", "component_id", "component")
    linked = out.filter("n > 0").join(of_class, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *carried, *named_class)
    return linked.unionAll(empty)

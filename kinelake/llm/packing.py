"""Hierarchical residual packing of token sequences.

Pieces are dealt evenly to partitions, each of which packs its own by best fit. Bins that are nearly full are sequences.
What is left rises in a tree: bins that lack little as items that others may fill up, and the pieces of emptier bins
as items of their own. A node packs the items of its children by best fit again, keeps what is nearly full, and passes on
the rest; the root packs all that reaches it. Nodes work on counts of items by fill, so that their size is bounded by
the capacity whatever the number of items; which item is in which sequence follows from its rank within its fill, and
goes down the same tree as ranges of ranks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import in_batches, stored
from kinelake.llm.tokens import default_vocabulary, encoded_blocks

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, row long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("row", pa.int64())])
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Bits of a rank in the sort key of a rule; the length is above them.
_RANK_BITS = 40
#: What a node says of its items: they are in sequences, they rise (in a bin or by themselves), how many of a fill rise, how many sequences it has.
_DONE, _RISES, _COUNT, _SEQUENCES = range(4)
_RULES = ["node", "kind", "child", "fill", "first", "n", "to_fill", "to", "phase", "per", "offset"]
_STEP = pa.struct([(name, pa.int64()) for name in ("start", "to", "phase", "per", "unit", "offset")])
_RANGES = "owner long, fill long, first long, n long, steps array<struct<start:long,to:long,phase:long,per:long,unit:long,offset:long>>"
_RANGES_ARROW = pa.schema([("owner", pa.int64()), ("fill", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("steps", pa.list_(_STEP))])


def fit_counts(lengths: list[int], counts: list[int], capacity: int) -> tuple[np.ndarray, int, list[tuple[int, int, int]]]:
    """Best-fit decreasing over counts of items by length, as rules, the number of bins, and (first, many, left) of the bins with room left.

    A rule is (key, rank, first, per, offset): from this rank among the items of its length on, bins from ``first`` on get
    ``per`` items each, at ``offset``. Equal bins are kept as ranges; an item's best fit stays its best fit while it has
    room, so a length fills range after range. A length splits two ranges at most, so the rules' number has a bound by
    the capacity that the number of items doesn't move. Rules are in the order of their key, length and rank.
    """
    rules: list[tuple[int, int, int, int, int]] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    mask = bins = 0

    def put(left: int, first: int, many: int) -> None:
        nonlocal mask
        if left and many:
            ranges.setdefault(left, []).append((first, many))
            mask |= 1 << left

    for n, rest in sorted(zip(lengths, counts, strict=True), reverse=True):
        rank = 0
        while rest:
            fitting = mask >> n
            if fitting:
                left = n + (fitting & -fitting).bit_length() - 1
                first, many = ranges[left].pop()
                if not ranges[left]:
                    mask &= ~(1 << left)
            else:
                left, first, many = capacity, bins, -(-rest // (capacity // n))
                bins += many
            per = left // n
            full = min(many, rest // per)
            last = rest - full * per if full < many else 0  # items of a bin that isn't filled
            rules.append((n << _RANK_BITS | rank, rank, first, per, capacity - left))
            put(left - per * n, first, full)
            if last:
                put(left - last * n, first + full, 1)
            put(left, first + full + bool(last), many - full - bool(last))
            rank += full * per + last
            rest -= full * per + last
    return np.array(sorted(rules), np.int64).reshape(-1, 5), bins, sorted((first, many, left) for left, own in ranges.items() for first, many in own)


def placed(rules: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of items by length and rank."""
    which = np.searchsorted(rules[:, 0], lengths << _RANK_BITS | ranks, "right") - 1
    _, rank, first, per, offset = rules[which].T
    return first + (ranks - rank) // per, offset + (ranks - rank) % per * lengths


def ranks_within(lengths: np.ndarray) -> np.ndarray:
    """Each item's number among those of its length, in order."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.searchsorted(ordered, ordered)
    return out


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and the bins' fills. Equal lengths keep their order."""
    own, counts = np.unique(lengths, return_counts=True)
    rules, n, _ = fit_counts(own.tolist(), counts.tolist(), capacity)
    bins, offsets = placed(rules, lengths, ranks_within(lengths))
    fills = np.zeros(n, np.int64)
    np.add.at(fills, bins, lengths)
    return bins, offsets, fills


def pack_node(child: np.ndarray, fill: np.ndarray, count: np.ndarray, capacity: int, slack: int, whole: int) -> tuple[list[tuple], dict[int, int], int]:
    """Pack a node's items, of which ``count`` have that fill and come from that child.

    Returns ranges of items (kind, child, fill, first, n, to_fill, to, phase, per, offset), how many items of each fill
    rise, and the number of sequences. Bins with ``slack`` tokens left at most are sequences; with ``whole`` at most they
    rise as items of their fill; the items of emptier bins rise by themselves. Of a range, item first + i goes to the
    sequence, or to the item of to_fill, number to + (phase + i) // per, and lies there at offset + (phase + i) % per fills.
    """
    order = np.lexsort((child, fill))
    child, fill, count = child[order], fill[order], count[order]
    own, start = np.unique(fill, return_index=True)
    totals = np.add.reduceat(count, start) if len(own) else count
    rules, bins, room = fit_counts(own.tolist(), totals.tolist(), capacity)
    # All bins in stretches that have the same left, full ones too, and what becomes of each.
    stretches, at = [], 0
    for first, many, left in [*room, (bins, 0, 0)]:
        if first > at:
            stretches.append((at, first - at, 0))
        if many:
            stretches.append((first, many, left))
        at = first + many
    done, rises, fate = 0, {}, []
    for first, many, left in stretches:
        if left <= slack:
            fate.append((_DONE, 0, done))
            done += many
        elif left <= whole:
            to_fill = capacity - left
            fate.append((_RISES, to_fill, rises.get(to_fill, 0)))
            rises[to_fill] = rises.get(to_fill, 0) + many
        else:
            fate.append(None)
    begins = [s[0] for s in stretches]
    by_fill = {f: (c, np.cumsum(n) - n, n) for f, c, n in zip(own.tolist(), np.split(child, start[1:]), np.split(count, start[1:]), strict=True)} if len(own) else {}
    total = dict(zip(own.tolist(), totals.tolist(), strict=True))
    out = []
    keys = (rules[:, 0] >> _RANK_BITS).tolist()
    for k, (_, rank, first, per, offset) in enumerate(rules.tolist()):
        f = keys[k]
        n = (rules[k + 1, 1] if k + 1 < len(rules) and keys[k + 1] == f else total[f]) - rank
        i = 0
        while i < n:
            b = first + i // per
            which = bisect_right(begins, b) - 1
            s_first, s_many, _ = stretches[which]
            m = int(min(n - i, (s_first + s_many - b) * per))
            if fate[which]:
                kind, to_fill, base = fate[which]
                _by_child(out, by_fill[f], (kind, f, to_fill, base + b - s_first, per, offset), rank + i, m)
            else:
                _by_child(out, by_fill[f], (_RISES, f, f, rises.get(f, 0), 1, 0), rank + i, m)
                rises[f] = rises.get(f, 0) + m
            i += m
    return out, rises, done


def _by_child(out: list[tuple], children: tuple[np.ndarray, np.ndarray, np.ndarray], rule: tuple, first: int, n: int) -> None:
    """A range of a node's items as ranges of its children's items."""
    names, begins, counts = children
    kind, fill, to_fill, to, per, offset = rule
    k = int(np.searchsorted(begins, first, "right")) - 1
    at = first
    while at < first + n:
        m = min(first + n, int(begins[k] + counts[k])) - at
        if m > 0:
            out.append((kind, int(names[k]), fill, at - int(begins[k]), m, to_fill, to + (at - first) // per, (at - first) % per, per, offset))
            at += m
        k += 1


def resolve(rules: list[tuple], above: list[tuple], base: int) -> list[tuple]:
    """Ranges of the children's items with the steps that lead to a sequence: (child, fill, first, n, steps).

    ``above`` are such ranges (fill, first, n, steps) of the node's own items; its sequences are numbered from ``base`` on.
    """
    known: dict[int, list[tuple]] = {}
    for fill, first, n, steps in sorted(above, key=lambda r: r[:2]):
        known.setdefault(fill, []).append((first, n, steps))
    begins = {fill: [r[0] for r in own] for fill, own in known.items()}
    out = []
    for kind, child, fill, first, n, to_fill, to, phase, per, offset in rules:
        if kind == _DONE:
            out.append((child, fill, first, n, [(first, base + to, phase, per, fill, offset)]))
            continue
        step = (first, to, phase, per, fill, offset)
        k = bisect_right(begins[to_fill], to) - 1
        at = 0
        while at < n:
            s_first, s_n, steps = known[to_fill][k]
            stop = min(n, (s_first + s_n - to) * per - phase)
            out.append((child, fill, first + at, stop - at, [step, *steps]))
            at, k = stop, k + 1
    return out


def follow(ranges: pa.Table, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset there of a partition's pieces, by the ranges of their lengths."""
    key = ranges.column("fill").to_numpy() << _RANK_BITS | ranges.column("first").to_numpy()
    order = np.argsort(key)
    rank = ranks_within(lengths)
    which = order[np.searchsorted(key[order], lengths << _RANK_BITS | rank, "right") - 1]
    steps = ranges.column("steps").combine_chunks()
    bounds, flat = np.asarray(steps.offsets), steps.values
    start, to, phase, per, unit, offset = (flat.field(name).to_numpy() for name in ("start", "to", "phase", "per", "unit", "offset"))
    at, end = bounds[:-1][which].astype(np.int64), bounds[1:][which]
    number, place = rank.copy(), np.zeros(len(lengths), np.int64)
    live = np.arange(len(lengths))
    while len(live):
        k = at[live]
        i = phase[k] + number[live] - start[k]
        number[live] = to[k] + i // per[k]
        place[live] += offset[k] + i % per[k] * unit[k]
        at[live] += 1
        live = live[at[live] < end[live]]
    return number, place


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None, slack: int = 4, partition: int = 32_768, fan_in: int = 16) -> DataFrame:
    """Pack token sequences of documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document's ids get ``end_id``
    appended; only documents longer than the capacity are cut, into pieces of the capacity and a rest.

    Text is tokenised once and not moved. Pieces are dealt by a hash to partitions of about ``partition`` pieces, so that
    each has all lengths alike, in whatever order documents come. Bins with ``slack`` tokens left at most are sequences
    at once; bins that lack an eighth of the capacity at most rise as items, other pieces by themselves, through nodes of
    ``fan_in`` children, and the root packs what is left. No bin is let go for any other reason than being nearly full.

    Null or empty text is the end id alone; a null doc_id is kept; repeated rows and ids are packed each for itself
    (told apart by their place); an empty table gives no rows. Other columns of docs are ignored.
    """
    path = vocabulary or default_vocabulary()

    def local(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_in = pc.fill_null(batch.column(0), 0).to_numpy()
            null_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for first, rows, ids, counts in encoded_blocks(batch, "text", path):
                table = _pieces(ids_in[first : first + rows], null_id[first : first + rows], ids, counts, capacity, end_id, part, seen)
                seen += table.num_rows
                yield from table.to_batches()

    pieces = stored(docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, local, SCHEMA), "packing")
    nodes = max(1, -(-pieces.count() // partition))
    dealt = pieces.withColumn("node", F.pmod(F.xxhash64("part", "row"), F.lit(nodes)))

    def pack(last: bool):
        def run(items: pa.Table) -> pa.Table:
            node = items.column("node")[0].as_py()
            columns = (items.column(c).to_numpy() for c in ("child", "fill", "n"))
            rules, rises, sequences = pack_node(*columns, capacity, capacity if last else slack, capacity // 8)
            rows = [(node, *r) for r in rules]
            rows += [(node, _COUNT, 0, fill, 0, n, 0, 0, 0, 0, 0) for fill, n in rises.items()] + [(node, _SEQUENCES, 0, 0, 0, sequences, 0, 0, 0, 0, 0)]
            return pa.table(dict(zip(_RULES, (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), strict=True)))

        return run

    items = dealt.groupBy("node", F.col("length").alias("fill")).agg(F.count("*").alias("n")).withColumn("child", F.col("node"))
    levels, bases, number = [], [], 0
    while True:
        rules = stored(items.select("node", "child", "fill", "n").groupBy("node").applyInArrow(pack(nodes == 1), ", ".join(f"`{c}` long" for c in _RULES)), "packing")
        most = rules.filter(F.col("kind") == _SEQUENCES).agg(F.max("n")).first()[0] or 0
        levels.append(rules)
        bases.append((number, most))  # of sequence numbers: those of a node follow those of the node before
        number += nodes * most
        if nodes == 1:
            break
        items = rules.filter(F.col("kind") == _COUNT).select(F.floor(F.col("node") / fan_in).cast("long").alias("node"), F.col("node").alias("child"), "fill", "n")
        nodes = -(-nodes // fan_in)

    def down(base: int, stride: int):
        def run(rules: pa.Table, above: pa.Table | None) -> pa.Table:
            if not rules.num_rows:
                return _RANGES_ARROW.empty_table()
            own = [tuple(r[c] for c in _RULES[1:]) for r in rules.filter(pc.less(rules.column("kind"), _COUNT)).to_pylist()]
            known = [(r["fill"], r["first"], r["n"], [tuple(s.values()) for s in r["steps"]]) for r in above.to_pylist()] if above is not None else []
            out = resolve(own, known, base + rules.column("node")[0].as_py() * stride)
            names = [f.name for f in _STEP]
            steps = pa.array([[dict(zip(names, s, strict=True)) for s in r[4]] for r in out], pa.list_(_STEP))
            return pa.table([*(pa.array([r[c] for r in out], pa.int64()) for c in range(4)), steps], schema=_RANGES_ARROW)

        return run

    root = down(*bases[-1])
    ranges = levels[-1].groupBy("node").applyInArrow(lambda rules: root(rules, None), _RANGES)
    for rules, base in zip(levels[-2::-1], bases[-2::-1], strict=True):
        ranges = rules.groupBy("node").cogroup(ranges.groupBy("owner")).applyInArrow(down(*base), _RANGES)

    def place(pieces: pa.Table, ranges: pa.Table) -> pa.Table:
        sequence, offset = follow(ranges, pieces.column("length").to_numpy()) if pieces.num_rows else (np.zeros(0, np.int64),) * 2
        return pieces.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("node").cogroup(ranges.groupBy("owner")).applyInArrow(place, PACKED)


def _pieces(doc_ids: np.ndarray, null_id: np.ndarray, ids: np.ndarray, counts: np.ndarray, capacity: int, end_id: int, part: int, seen: int) -> pa.Table:
    """The pieces of a run of documents, numbered after those ``seen``."""
    docs, piece, start, length, crc = [], [], [], [], []
    at = 0
    end = np.array([end_id], "<u4").tobytes()
    raw = ids.astype("<u4", copy=False).tobytes()
    for k, n in enumerate(counts.tolist()):
        own = raw[4 * at : 4 * (at + n)] + end
        at += n
        for number, s in enumerate(range(0, n + 1, capacity)):
            size = min(capacity, n + 1 - s)
            docs.append(k)
            piece.append(number)
            start.append(s)
            length.append(size)
            crc.append(zlib.crc32(own[4 * s : 4 * (s + size)]))
    which = np.array(docs, np.int64)
    rows = len(which)
    none = null_id[which]
    sizes = np.array(length, np.int64)
    return pa.table([pa.array(np.where(none, 0, doc_ids[which]).astype(np.int64), mask=none), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(np.full(rows, part, np.int64)), pa.array(seen + np.arange(rows))], schema=ARROW)

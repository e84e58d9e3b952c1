"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import LOWER, byte_class, coded_words, hash_words, in_batches, ragged, stored, text_blocks, word_spans

#: Bytes of words: ASCII digits and letters, and all bytes of longer characters.
WORD = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Text bytes of an index segment, about.
SEGMENT_BYTES = 1 << 21
#: Windows searched in one pass over the index; more are searched in several passes.
BLOCK_WINDOWS = 200_000
#: Postings looked up together.
LOOKUPS = 1 << 20
MATCHES = "array<struct<item_id:long,start:long,stop:long>>"
_PARTS = ("doc_ids", "doc_null", "doc_first", "terms", "text_first", "text", "term_first", "positions")
_TYPES = {"doc_ids": np.int64, "doc_null": np.bool_, "doc_first": np.int64, "terms": np.uint64, "text_first": np.int64, "text": np.uint8, "term_first": np.int64, "positions": np.uint32}


@dataclass
class Segment:
    """The postings of a run of documents; positions count words over the run, ascending within a term."""

    doc_ids: np.ndarray
    doc_null: np.ndarray
    doc_first: np.ndarray
    terms: np.ndarray
    text_first: np.ndarray
    text: np.ndarray
    term_first: np.ndarray
    positions: np.ndarray

    def __post_init__(self):
        df = np.diff(self.term_first)
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.uint64) << np.uint64(32), df) | self.positions

    def numbers(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The words' term numbers, -1 for those that don't occur; the words themselves are compared."""
        if not len(self.terms):
            return np.full(len(words), -1, np.int64)
        found = np.full(len(words), -1, np.int64)
        low, high = np.searchsorted(self.terms, hashes), np.searchsorted(self.terms, hashes, "right")
        for k in np.flatnonzero(low < high).tolist():
            for t in range(low[k], high[k]):  # different words with one hash are terms beside each other
                if self.text[self.text_first[t] : self.text_first[t + 1]].tobytes() == words[k]:
                    found[k] = t
        return found

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list."""
        key = term.astype(np.uint64) << np.uint64(32) | position.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)


def make_segment(doc_ids: np.ndarray, doc_null: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Segment:
    """The index of the documents whose texts are data[starts:ends]."""
    low = LOWER[data]
    begin, end, doc_first = word_spans(low, starts, ends, WORD)
    which, values, _ = coded_words(low, begin, end)
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.uint64)
    rank[order] = np.arange(len(values), dtype=np.uint64)
    keys = rank[which] << np.uint64(32) | np.arange(len(begin), dtype=np.uint64) if len(begin) else np.zeros(0, np.uint64)
    keys.sort()
    positions = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    term_first = np.searchsorted(keys, np.arange(len(values) + 1, dtype=np.uint64) << np.uint64(32))
    sample = positions[term_first[:-1]]
    lengths = (end - begin)[sample]
    return Segment(doc_ids, doc_null, doc_first, values[order], np.concatenate([[0], np.cumsum(lengths)]), low[ragged(begin[sample], lengths)], term_first, positions)


def build_index(docs: DataFrame) -> DataFrame:
    """Store the positional index of docs (doc_id, text): a row per segment of whole documents, with all postings.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and of any other characters beyond ASCII. Null and
    empty texts are documents without words; null and repeated ids stay rows of their own; an empty table gives an
    empty index. A segment covers some megabytes of text, or one longer document. Building needs no shuffle.
    """

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for first, data, starts, ends in text_blocks(batch, "text", SEGMENT_BYTES):
                rows = slice(first, first + len(starts))
                s = make_segment(ids[rows], null[rows], data, starts, ends)
                yield pa.record_batch([pa.array([number]), *(pa.array([np.ascontiguousarray(getattr(s, p), _TYPES[p]).tobytes()], pa.binary()) for p in _PARTS)], names=["segment", *_PARTS])
                number += 1

    schema = "segment long, " + ", ".join(f"{p} binary" for p in _PARTS)
    return stored(docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, build, schema), "postings", 16 << 20)


def read_segment(row: dict) -> Segment:
    return Segment(*(np.frombuffer(row[p] or b"", _TYPES[p]) for p in _PARTS))


@dataclass
class Phrases:
    """Windows of item words, as numbers of the distinct words; shorter windows are filled up with -1."""

    words: list[bytes]
    hashes: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    item: np.ndarray


def _words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    begin, end, _ = word_spans(data, np.array([0]), np.array([len(data)]), WORD)
    return [data[b:e].tobytes() for b, e in zip(begin.tolist(), end.tolist(), strict=True)]


def phrase_blocks(items, window: int, limit: int):
    """Phrases of (item_id, text) rows in blocks of about ``limit`` windows: each item's runs of ``window`` words, or all its words if fewer."""
    number: dict[bytes, int] = {}
    rows, lengths, owners = [], [], []

    def block():
        table = np.full((len(rows), window), -1, np.int64)
        for k, r in enumerate(rows):
            table[k, : len(r)] = r
        words = list(number)
        return Phrases(words, hash_words(words), table, np.array(lengths), np.array(owners, np.int64))

    for item_id, text in items:
        coded = [number.setdefault(w, len(number)) for w in _words(text)] if item_id is not None else []
        for k in range(max(1, len(coded) - window + 1) if coded else 0):
            rows.append(coded[k : k + window])
            lengths.append(len(rows[-1]))
            owners.append(item_id)
        if len(rows) >= limit:
            yield block()
            number, rows, lengths, owners = {}, [], [], []
    if rows:
        yield block()


def find_phrases(segment: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """All exact occurrences: the windows found and the positions of their first words.

    Lists are intersected from a window's rarest term on: its positions less its offset are candidates, which the
    lists of the other terms, rarer ones first, must hold at their own offsets.
    """
    number = segment.numbers(phrases.words, phrases.hashes)
    count = np.diff(segment.term_first)
    df = np.where(number >= 0, count[number] if len(count) else 0, 0)
    used = phrases.windows >= 0
    each = np.where(used, df[phrases.windows], np.iinfo(np.int64).max)
    live = np.flatnonzero((each > 0).all(axis=1))
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_rarity = np.argsort(each[live], axis=1, kind="stable")
    rare = by_rarity[:, 0]
    least = each[live, rare]
    doc_end = segment.doc_first[1:]
    found_window, found_start = [], []
    first = 0
    total = np.cumsum(least)
    while first < len(live):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + LOOKUPS, "right")))
        part = np.arange(first, last)
        term = number[phrases.windows[live[part], rare[part]]]
        row = np.repeat(part, least[part])
        start = segment.positions[ragged(segment.term_first[term], least[part])].astype(np.int64) - np.repeat(rare[part], least[part])
        keep = start >= 0
        row, start = row[keep], start[keep]
        doc = np.searchsorted(segment.doc_first, start, "right") - 1
        keep = start + phrases.length[live[row]] <= doc_end[np.minimum(doc, len(doc_end) - 1)]
        row, start = row[keep], start[keep]
        for k in range(1, by_rarity.shape[1]):
            offset = by_rarity[row, k]
            word = phrases.windows[live[row], offset]
            ask = word >= 0
            keep = np.ones(len(row), bool)
            keep[ask] = segment.holds(number[word[ask]], start[ask] + offset[ask])
            row, start = row[keep], start[keep]
        found_window.append(live[row])
        found_start.append(start)
        first = last
    return np.concatenate(found_window), np.concatenate(found_start)


def _merged(doc: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching spans of a document and item become one."""
    order = np.lexsort((stop, start, item, doc))
    doc, item, start, stop = doc[order], item[order], start[order], stop[order]
    if not len(doc):
        return doc, item, start, stop
    # Spans of one document and item that overlap: sort is by start, so a running maximum of stops tells where one ends.
    group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))])
    big = stop.max() + 1
    reach = np.maximum.accumulate(stop + group * big) - group * big
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return doc[at], item[at], start[at], np.maximum.reduceat(stop, at)


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """A row per indexed document: segment, place, doc_id, n_words, and matches (item_id, start, stop in words).

    Matches are exact occurrences of windows of ``window`` consecutive words of items (item_id, text), overlapping ones
    of an item merged. An item with fewer words is one window; items without words, or with a null id, match nothing;
    items with equal ids are one. Items are read in blocks of bounded size, each sent to all segments; a document's
    matches of several blocks are put together afterwards.
    """
    spark = index.sparkSession
    schema = f"segment long, place long, doc_id long, n_words long, matches {MATCHES}"

    def search(block: Phrases | None, all_docs: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_WINDOWS windows and one item's more

        def run(batches):
            own = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    segment = read_segment(row)
                    yield from _rows(row["segment"], segment, own, all_docs)

        return index.transform(in_batches, run, schema)

    found: list[DataFrame] = []
    rows = ((r["item_id"], r["text"]) for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator())
    for block in phrase_blocks(rows, window, BLOCK_WINDOWS):
        found.append(search(block, all_docs=not found))
    if not found:
        found.append(search(None, True))
    if len(found) == 1:
        return found[0]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.groupBy("segment", "place").agg(F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))


def _rows(number: int, segment: Segment, phrases: Phrases | None, all_docs: bool):
    n_words = np.diff(segment.doc_first)
    doc, item, start, stop = np.zeros((4, 0), np.int64)
    if phrases is not None:
        which, at = find_phrases(segment, phrases)
        own = np.searchsorted(segment.doc_first, at, "right") - 1
        begin = at - segment.doc_first[own]
        doc, item, start, stop = _merged(own, phrases.item[which], begin, begin + phrases.length[which])
    places = np.arange(len(n_words)) if all_docs else np.unique(doc)
    bounds = np.append(np.searchsorted(doc, places), len(doc)) if len(places) else np.zeros(1, np.int64)
    matches = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (item, start, stop)], ["item_id", "start", "stop"]))
    yield pa.record_batch([pa.array(np.full(len(places), number)), pa.array(places), pa.array(segment.doc_ids[places], mask=segment.doc_null[places]), pa.array(n_words[places]), matches], names=["segment", "place", "doc_id", "n_words", "matches"])


def proximity_matches(index: DataFrame, words: list[str], slop: int = 5) -> DataFrame:
    """Places where all words occur within ``slop`` words of an occurrence of the rarest: segment, place, doc_id, position.

    Words are compared as indexed; words of no or several indexed words are refused. Nothing is returned for an
    empty list.
    """
    coded = [_words(w) for w in words]
    if any(len(w) != 1 for w in coded):
        raise ValueError("each query word has to be one indexed word")
    keys = sorted({w[0] for w in coded})
    hashes = hash_words(keys)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = read_segment(row)
                number = s.numbers(keys, hashes)
                if not len(number) or (number < 0).any():
                    continue
                count = np.diff(s.term_first)[number]
                order = np.argsort(count, kind="stable")
                lists = [s.positions[s.term_first[t] : s.term_first[t + 1]].astype(np.int64) for t in number[order]]
                at = lists[0]
                doc = np.searchsorted(s.doc_first, at, "right") - 1
                for other in lists[1:]:
                    low = np.maximum(at - slop, s.doc_first[doc])
                    high = np.minimum(at + slop, s.doc_first[doc + 1] - 1)
                    keep = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
                    at, doc = at[keep], doc[keep]
                yield pa.record_batch([pa.array(np.full(len(at), row["segment"])), pa.array(doc), pa.array(s.doc_ids[doc], mask=s.doc_null[doc]), pa.array(at - s.doc_first[doc])], names=["segment", "place", "doc_id", "position"])

    return index.transform(in_batches, run, "segment long, place long, doc_id long, position long")

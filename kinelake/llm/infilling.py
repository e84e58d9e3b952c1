"""Fill-in-middle transformation over an index of distinct texts, whose line boundaries are Elias-Fano lists.

Texts that occur once are index entries where they lie: their list is made, and cut, without moving the text. Which texts
may occur again is told by a filter of fixed size. These are grouped by their whole content, each group's list is made
once and stored with its text, and documents join it by the text's SHA-256, ids only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import FILTER_BITS, bit_filter, in_batches, maybe, stored

MARKS = ("<P>", "<S>", "<M>")
CUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
#: Characters of output in a batch that goes back to Spark, about.
FLUSH = 1 << 22
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


@dataclass
class EliasFano:
    """An ascending list of n integers: ``low`` has the last ``bits`` bits of each, ``high`` a one at place (value >> bits) + index for each."""

    n: int
    bits: int
    low: bytes
    high: bytes

    def __post_init__(self):
        self._bytes = np.frombuffer(self.high, np.uint8)
        self._before = np.cumsum(_ONES[self._bytes])

    def select(self, k: int) -> int:
        """The k-th value, from 0: its high part is the place of the k-th one, less k."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        byte = int(np.searchsorted(self._before, k, "right"))
        earlier = int(self._before[byte - 1]) if byte else 0
        bit = int(np.flatnonzero(np.unpackbits(self._bytes[byte : byte + 1], bitorder="little"))[k - earlier])
        first = k * self.bits
        word = int.from_bytes(self.low[first // 8 : (first + self.bits + 7) // 8], "little") >> first % 8
        return (8 * byte + bit - k) << self.bits | word & ((1 << self.bits) - 1)


def elias_fano(values: np.ndarray) -> EliasFano:
    """The list of ascending integers, none negative."""
    n = len(values)
    bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
    low = (values[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel()
    places = (values >> bits) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    return EliasFano(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, in code points: after its line feed, or with the text."""
    data = np.frombuffer(text.encode(), np.uint8)
    points = (data & 0xC0) != 0x80
    ends = np.cumsum(points)[data == 10] if len(data) else np.zeros(0, np.int64)
    return ends if text.endswith("\n") or not text else np.append(ends, len(text))


def cut(doc_id: int | None, text: str, lines: EliasFano, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> tuple:
    """One document's (n, form, prefix_chars, middle_chars, output).

    Four numbers from the SHA-256 of ``seed:doc_id`` (an empty string for a null id) choose two line ends, whether the
    document is changed (``rate`` in 100) and its form (``spm`` in 100, else psm).
    """
    n = lines.n
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, stop = (lines.select(k - 1) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", start, stop - start, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", start, stop - start, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which an output of that form was made. A changed text holds no mark, so the three that are there tell its parts."""
    p, s, m = (rf"\Q{x}\E" for x in marks)
    psm = F.split(output, f"{p}|{s}|{m}", -1)  # "", prefix, suffix, middle
    spm = F.split(output, f"{s}|{p}|{m}", -1)  # "", suffix, prefix, middle
    return F.when(form == "psm", F.concat(psm[1], psm[3], psm[2])).when(form == "spm", F.concat(spm[2], spm[3], spm[1])).otherwise(output)


def _batches(rows):
    """Rows of CUTS as record batches of bounded size."""
    held, size = [], 0
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > FLUSH:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=_NAMES)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Store the index of distinct texts of docs (key, text), key the text's SHA-256: key, text, n, bits, low, high.

    Rows are grouped by the text itself, combined before they are dealt, and each group's list of line ends is made once.
    """
    distinct = docs.groupBy("key", "text").agg(F.count("*").alias("copies")).drop("copies")

    def make(batches):
        for batch in batches:
            lists = [elias_fano(line_ends(t.as_py())) for t in batch.column(1)]
            parts = [pa.array([getattr(x, name) for x in lists], kind) for name, kind in (("n", pa.int64()), ("bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()))]
            yield pa.record_batch([*batch.columns, *parts], names=["key", "text", "n", "bits", "low", "high"])

    return stored(distinct.transform(in_batches, make, "key binary, text string, n long, bits int, low binary, high binary"), "lines", 16 << 20)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Cut every whole text of docs (doc_id, text) into prefix, middle and suffix at line ends and put them in another order.

    Returns doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain), output.
    A line is a run up to and with its line feed, or what follows the last one. Texts with a mark in them stay plain.

    Null text is the empty text, which stays plain; a null doc_id is hashed as an empty string; repeated rows and ids give
    a row each, ties none; an empty table gives no rows; other columns of docs are ignored, whatever their names. Texts
    have any length a row may have, and a batch holds one of these or some megabytes of shorter ones.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = texts.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(FILTER_BITS)))
    repeated = marked.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select("place")
    bits = spark.sparkContext.broadcast(bit_filter(repeated))  # of fixed size; if it's full, all texts go through the index

    def alone(batches):
        def rows():
            for batch in batches:
                for k in np.flatnonzero(~maybe(bits.value, batch.column(2).to_numpy())).tolist():
                    doc_id, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    yield doc_id, *cut(doc_id, text, elias_fano(line_ends(text)), seed, rate, spm, marks)

        yield from _batches(rows())

    def again(batches):
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(maybe(bits.value, batch.column(2).to_numpy())))

    copies = marked.transform(in_batches, again, "doc_id long, text string").withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    index = distinct_lines(copies.select("key", "text"))
    # Spark splits what a key of very many documents gets, as both sides of the join are dealt for it alone.
    joined = copies.select("doc_id", "key").join(index, "key").select("doc_id", "key", "text", "n", "bits", "low", "high")

    def from_index(batches):
        def rows():
            key, lines, text = None, None, ""
            for batch in batches:
                for k in range(batch.num_rows):
                    own = batch.column(1)[k].as_py()
                    if own != key:  # rows of a text follow each other
                        key, text = own, batch.column(2)[k].as_py()
                        lines = EliasFano(*(batch.column(c)[k].as_py() for c in range(3, 7)))
                    doc_id = batch.column(0)[k].as_py()
                    yield doc_id, *cut(doc_id, text, lines, seed, rate, spm, marks)

        yield from _batches(rows())

    return marked.transform(in_batches, alone, CUTS).unionAll(joined.transform(in_batches, from_index, CUTS))

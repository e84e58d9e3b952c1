"""Helpers shared by the training-data operators: durable intermediate tables and vectorised text handling."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
#: Bits of the filter that says which keys occur; a full one lets more through, never fewer.
FILTER_BITS = 1 << 27
#: Bytes of an Arrow batch between Spark and Python, at most about; the session's setting if that is smaller.
BATCH_BYTES = 8 << 20
#: Bytes of a row group of stored tables, about.
ROW_GROUP = 128 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a folder of our own is made, which only a local session can share; any other master is refused.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="kinelake-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, row_group: int = ROW_GROUP) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    Tables of large rows take a small ``row_group`` (bytes), as readers hold a group at a time; their writers look at the
    size after each row instead of after a hundred, which could hold hundreds of megabytes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", row_group)
    (writer if row_group >= ROW_GROUP else writer.option("parquet.page.size.row.check.min", 1)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later plan reads; others are left alone."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that are no longer referred to, rather than when the driver's heap fills."""
    gc.collect()
    spark._jvm.System.gc()


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with bounded batches, in workers that give memory back."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)

    def lean(batches):
        release = _return_memory()
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def _return_memory():
    """Have large arrays returned to the system when they are freed; gives a function that returns the rest."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # from this size on, blocks are mapped by themselves
    except (OSError, AttributeError):  # another C library: it keeps its ways
        return pa.default_memory_pool().release_unused

    def release():
        pa.default_memory_pool().release_unused()
        libc.malloc_trim(0)

    return release


def bit_filter(places: DataFrame) -> np.ndarray:
    """Which of the FILTER_BITS places (column place) occur, as packed bits; its size doesn't follow the input's."""
    chunk = 1 << 19

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(chunk, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = places.select(F.floor(F.col("place") / chunk).alias("chunk"), (F.col("place") % chunk).alias("bit")).distinct().groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["chunk"] * (chunk // 8) : (r["chunk"] + 1) * (chunk // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes; null texts count as empty.

    Yields (first row, data, starts, ends): data is the UTF-8 of the run's texts, row k's text is data[starts[k]:ends[k]].
    A longer text is a run by itself; texts are never cut.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        o = offsets[first : last + 1]
        yield first, data[o[0] : o[-1]], o[:-1] - o[0], o[1:] - o[0]
        first = last


def byte_class(keep) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(keep(b)) for b in range(256)])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Multipliers of the hash of words (those of XXH64), and the bytes up to which words are hashed side by side.
_P1, _P2, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of ``inside`` bytes, broken at row ends, and each row's first word (with the total last)."""
    mask = inside[data]
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(starts) + 1, np.int64)
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    full = ends > starts
    before[starts[full]] = False
    after[ends[full] - 1] = False
    begin = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return begin, end, np.append(np.searchsorted(begin, starts), len(begin))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as an integer; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _lanes(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of spans of which ``left`` bytes are left, without what follows them."""
    lane = eights[at].astype(np.uint64)
    few = left < 8
    lane[few] &= (np.uint64(1) << (left[few] * 8).astype(np.uint64)) - np.uint64(1)
    return lane


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data: eight bytes after the other go through multiplications and rotations, as in XXH64.

    Longer spans get the first bytes of their BLAKE2 digest.
    """
    length = end - begin
    h = length.astype(np.uint64) * _P5 + _P1
    eights = _eights(data)
    which, at, left = np.arange(len(begin)), begin, length
    if len(long := np.flatnonzero(length > SHORT)):
        which = np.flatnonzero(length <= SHORT)
        at, left = begin[which], length[which]
    while len(which):
        own = h[which] ^ _turned(_lanes(eights, at, left) * _P2, 31) * _P1
        h[which] = _turned(own, 27) * _P1 + _P4
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def same_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span at the place ``other``, which has its hash.

    Hashes of spans of one length up to eight bytes differ if the spans do, as each step can be undone.
    """
    length = end - begin
    same = length == length[other]
    eights = _eights(data)
    which = np.flatnonzero(same & (length > 8) & (other != np.arange(len(other))))
    long = which[length[which] > SHORT]
    which = which[length[which] <= SHORT]
    at, with_, left = begin[which], begin[other[which]], length[which]
    while len(which):
        same[which] &= _lanes(eights, at, left) == _lanes(eights, with_, left)
        more = left > 8
        which, at, with_, left = which[more], at[more] + 8, with_[more] + 8, left[more] - 8
    for k in long.tolist():
        same[k] = np.array_equal(data[begin[k] : end[k]], data[begin[other[k]] : end[other[k]]])
    return same


def coded_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the spans by their bytes, and for each number its hash and the place of its first span.

    Numbers go by hashes; spans whose bytes aren't those of their number's first span get numbers of their own.
    """
    coded = pa.array(word_hashes(data, begin, end)).dictionary_encode()
    which, hashes = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.zeros(len(hashes), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    clash = np.flatnonzero(~same_words(data, begin, end, first[which]))
    if len(clash):
        which, own, more = which.copy(), {}, []
        for k in clash.tolist():
            word = data[begin[k] : end[k]].tobytes()
            if word not in own:
                own[word] = len(hashes) + len(own)
                more.append(k)
            which[k] = own[word]
        hashes = np.concatenate([hashes, word_hashes(data, begin[more], end[more])])
        first = np.concatenate([first, np.array(more, np.int64)])
    return which, hashes, first


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hashes for words that are given one by one."""
    lengths = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(lengths)
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), end - lengths, end)


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[0] .. first[0]+length[0]-1, first[1] .., one run after the other."""
    total = int(length.sum())
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(total)

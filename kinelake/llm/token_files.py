"""Binary token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A data set is a folder that holds ``ranks.bin`` (the ids by falling frequency, unsigned 32-bit), shards, a Parquet table
``shards`` of their names, sizes and first tokens, and a manifest.
A shard has, after the magic and four little-endian 64-bit numbers (documents, tokens, control bytes, data bytes):
document ids (signed 64-bit; the smallest value stands for null), token counts (unsigned 64-bit), one control byte for
four tokens (two bits each: bytes of its rank less one), and the ranks' bytes, least significant first.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm.common import discard, in_batches, new_path, stored
from kinelake.llm.tokens import default_vocabulary, encoded_blocks

MAGIC = b"KLTOKEN1"
NULL_ID = -(1 << 63)
#: Tokens of a shard, about; a shard is what one reader holds in memory.
SHARD_TOKENS = 1 << 22
#: Ranges of doc_id that documents are dealt into, at most, and ids that are sampled for each to choose the ranges.
BUCKETS, SAMPLE = 1 << 14, 64
#: By control byte, the bytes of its four ranks.
WIDTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype(np.uint32, copy=False)
    width = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = width - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    at = np.cumsum(width) - width
    data = np.zeros(int(width.sum()), np.uint8)
    for k in range(4):
        own = width > k
        data[at[own] + k] = (ranks[own] >> np.uint32(8 * k)) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks back: widths come from the table, values from gathered bytes."""
    width = WIDTHS[control].ravel()[:n]
    at = np.cumsum(width) - width
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, 4):
        own = np.flatnonzero(width > k)
        if not len(own):
            break
        out[own] |= padded[at[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, content: bytes) -> None:
    """Write a file whole or not at all: a repeated task overwrites it with the same content."""
    store, path = _open(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary, compression=None) as f:
        f.write(content)
    store.move(temporary, path)


def read_bytes(uri: str) -> bytes:
    store, path = _open(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def _shard(doc_ids: list[int], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    return MAGIC + struct.pack("<4Q", len(doc_ids), len(ranks), len(control), len(data)) + np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<u8").tobytes() + control + data


def read_shard(content: bytes, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, token counts and all token ids of a shard."""
    if content[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, tokens, n_control, n_data = struct.unpack_from("<4Q", content, 8)
    at = list(accumulate([40, 8 * docs, 8 * docs, n_control, n_data]))
    if at[-1] != len(content):
        raise ValueError("a token shard is cut short")
    ids = np.frombuffer(content, "<i8", docs, at[0])
    counts = np.frombuffer(content, "<u8", docs, at[1]).astype(np.int64)
    ranks = decode_ranks(np.frombuffer(content, np.uint8, n_control, at[2]), np.frombuffer(content, np.uint8, n_data, at[3]), tokens)
    return ids, counts, by_rank[ranks]


def write_token_files(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None, folder: str | None = None) -> str:
    """Write the token ids of documents (doc_id, text) in ascending doc_id order; returns the folder's URI.

    Every text is tokenised once and whole, and ``end_id`` closes it. Null or empty text is the end id alone. Null
    doc_ids come first; equal ids are ordered by a hash of their texts, so repeated rows stay as repeated documents, and
    an id of very many rows is dealt to several tasks. An
    empty table gives a data set without shards. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    folder = folder or new_path(spark, "token-files")
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, rows, ids, counts in encoded_blocks(batch, "text", path):
                raw, at, out = ids.astype("<u4", copy=False).tobytes(), 0, []
                for n in counts.tolist():
                    own = np.frombuffer(raw[4 * at : 4 * (at + n)] + end, np.uint8).reshape(-1, 4)
                    out.append(squeeze.compress(np.ascontiguousarray(own.T).tobytes()))  # byte by byte: high bytes are alike
                    at += n
                ids_here, mark = batch.column(0).slice(first, rows), batch.column(2).slice(first, rows)
                bucket = _bucket(cuts, pc.fill_null(ids_here, NULL_ID).to_numpy(), mark.to_numpy())
                yield pa.record_batch([ids_here, mark, pa.array(out, pa.binary()), pa.array(bucket, pa.int32())], names=["doc_id", "mark", "packed", "bucket"])

    # Cut points of doc_id come from a sample of that column alone, so that texts are tokenised once.
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"))
    parts = min(BUCKETS, max(1, ids.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = max(1, ids.count() // (SAMPLE * parts))
    some = np.sort(np.array([r[0] for r in ids.filter(F.rand(7) * every < 1).collect()], np.int64))  # about SAMPLE * parts numbers
    cuts = some[np.arange(1, parts) * len(some) // parts] if len(some) else some
    coded = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).transform(in_batches, tokenise, "doc_id long, mark long, packed binary, bucket int")
    ordered = stored(coded.repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "mark", "packed"), "tokens")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in _unpack(batch):
                seen = np.bincount(ids)
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # At most one row per id of the vocabulary reaches the driver.
    frequency = ordered.select("packed").transform(in_batches, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_rank = frequency.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)
    write_bytes(f"{folder}/ranks.bin", by_rank.astype("<u4").tobytes())
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)  # bounded by the vocabulary

    def write(frames):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for bucket, batches in _by_bucket(frames):
            held_ids, held_counts, held, made, tokens = [], [], [], 0, 0
            rows = []

            def flush():
                nonlocal made, tokens
                name = f"shard-{bucket:08d}-{part:06d}-{made:06d}.tok"
                write_bytes(f"{folder}/{name}", _shard(held_ids, held_counts, table.value[np.concatenate(held)]))
                rows.append((bucket, held_ids[0], name, len(held_ids), tokens))
                for x in (held_ids, held_counts, held):
                    x.clear()
                made, tokens = made + 1, 0

            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), _unpack(batch), strict=True):
                    held_ids.append(NULL_ID if doc_id is None else doc_id)
                    held_counts.append(len(ids))
                    held.append(ids)
                    tokens += len(ids)
                    if tokens >= SHARD_TOKENS:
                        flush()
            if held:
                flush()
            frame = pd.DataFrame(rows, columns=["bucket", "first_id", "name", "docs", "tokens"])
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    # A short row per shard, in a table. Only the buckets' totals, at most BUCKETS, reach the driver.
    shards = stored(ordered.select("doc_id", "packed", "bucket").transform(in_batches, write, "bucket long, first_id long, name string, docs long, tokens long"), "written")
    totals = sorted((r["bucket"], r["n"]) for r in shards.groupBy("bucket").agg(F.sum("tokens").alias("n")).collect())
    begins = dict(zip((b for b, _ in totals), accumulate([0, *(n for _, n in totals)]), strict=False))
    begin = spark.createDataFrame(list(begins.items()), "bucket long, begin long")
    before = Window.partitionBy("bucket").orderBy("first_id", "name").rowsBetween(Window.unboundedPreceding, -1)
    starts = (F.col("begin") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("start")
    shards.join(F.broadcast(begin), "bucket").select("name", "docs", "tokens", starts).write.parquet(f"{folder}/shards")
    discard(ordered, shards)
    about = {"vocabulary": path.rsplit("/", 1)[-1], "end_id": end_id, "tokens": sum(n for _, n in totals)}
    write_bytes(f"{folder}/manifest.json", json.dumps(about).encode())
    return folder


def _bucket(cuts: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The buckets of documents, in the order of id and mark. An id that is several cuts has as many buckets, by its marks."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    part = (mark.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    return low + (part * np.maximum(high - low, 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _unpack(batch: pa.RecordBatch):
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for x in batch.column(batch.schema.get_field_index("packed")):
        planes = np.frombuffer(expand.decompress(x.as_py()), np.uint8).reshape(4, -1)
        yield np.ascontiguousarray(planes.T).view("<u4").ravel()


def _by_bucket(batches):
    """(bucket, batches) for each run of equal values in the last column."""
    waiting = iter(batches)
    rest = None

    def own(bucket, first):
        nonlocal rest
        part = first
        while part is not None:
            keys = part.column(part.num_columns - 1).to_numpy()
            n = int(np.append(np.flatnonzero(keys != bucket), len(keys))[0])
            if n:
                yield part.slice(0, n)
            if n < len(keys):
                rest = part.slice(n)
                return
            part = next((b for b in waiting if b.num_rows), None)
        rest = None

    rest = next((b for b in waiting if b.num_rows), None)
    while rest is not None:
        bucket = rest.column(rest.num_columns - 1)[0].as_py()
        yield bucket, own(bucket, rest)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read a data set back: a row per document with doc_id, start, n_tokens and ids (array of token ids)."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids array<long>", lambda ids: pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))


def digest_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """As read_token_files, with the crc32 of a document's ids (little-endian unsigned 32-bit) in their place."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _read(spark: SparkSession, folder: str, schema: str, last) -> DataFrame:
    names = spark.read.parquet(f"{folder}/shards").select("name", "start")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = schema.rsplit(",", 1)[1].split()[0]

    def read(batches):
        by_rank = np.frombuffer(read_bytes(f"{folder}/ranks.bin"), "<u4")
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, counts, ids = read_shard(read_bytes(f"{folder}/{shard}"), by_rank)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                for k in range(0, len(doc_ids), 1000):
                    own = slice(k, min(k + 1000, len(doc_ids)))
                    texts = [ids[bounds[j] : bounds[j + 1]] for j in range(own.start, own.stop)]
                    yield pa.record_batch([pa.array(doc_ids[own], mask=doc_ids[own] == NULL_ID), pa.array(start + bounds[own.start : own.stop]), pa.array(counts[own]), last(texts)], names=["doc_id", "start", "n_tokens", name])

    return names.repartition(parts, "name").transform(in_batches, read, schema)

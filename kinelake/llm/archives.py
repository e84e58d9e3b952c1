"""Legacy ARC archives, converted to WARC."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import FILTER_BITS, bit_filter, discard, in_batches, maybe, new_path, stored
from kinelake.llm.token_files import read_bytes, write_bytes

# Fixed values of the ARC format: the fields of a record's header line by the version that the archive declares.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_FIELD_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6f0c4f5e-7f0e-5d8e-9f4e-2b0a4c1d9e77")
#: Bytes of payloads in an archive, about; an archive is what one task holds in memory.
ARCHIVE_BYTES = 8 << 20


def _word(value: str | None) -> str:
    """A header field: white space and control characters percent-encoded, '-' where empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "") or "-"


def write_arc(pages, version: int, name: str, date: str) -> bytes:
    """An ARC archive of (page_id, url, payload) as HTTP responses."""
    about = f"{version} 0 kinelake\n{ARC_FIELD_NAMES[version]}\n\n".encode()

    def line(values: dict) -> bytes:
        return (" ".join(str(values.get(f, "-")) for f in ARC_FIELDS[version]) + "\n").encode()

    out = [line({"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": 200, "offset": 0, "filename": name, "length": len(about)}), about, b"\n"]
    at = sum(map(len, out))
    for page_id, url, payload in pages:
        id_line = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{id_line}\r\n".encode() + payload
        head = line({"url": _word(url), "ip": "0.0.0.0", "date": date, "type": "text/html", "status": 200, "offset": at, "filename": name, "length": len(block)})
        out += [head, block, b"\n"]
        at += len(head) + len(block) + 1
    return b"".join(out)


def read_arc(content: bytes):
    """The records of an ARC archive, as dicts of the header line's fields with their block.

    The first record declares the version and with it the fields of all header lines. Blocks are cut by their declared
    lengths, whatever they hold; an archive that ends within a block, or a line of other fields, is refused.
    """
    at, fields = 0, None
    while at < len(content):
        stop = content.find(b"\n", at)
        if stop < 0:
            raise ValueError("an ARC header line has no end")
        words = content[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not words[0]:  # blank lines between records
            at = stop + 1
            continue
        if not words[-1].isdigit():
            raise ValueError(f"an ARC header line without length: {words}")
        block = content[stop + 1 : stop + 1 + int(words[-1])]
        if len(block) != int(words[-1]):
            raise ValueError("an ARC archive ends within a block")
        if fields is None:
            version = block.split(b" ", 1)[0]
            if not words[0].startswith("filedesc://") or version not in (b"1", b"2"):
                raise ValueError("an ARC archive of no known version")
            fields = ARC_FIELDS[int(version)]
        elif len(words) != len(fields):
            raise ValueError(f"an ARC header line of {len(words)} fields, not {len(fields)}")
        else:
            yield dict(zip(fields, words, strict=True)) | {"block": block}
        at = stop + 1 + len(block)
        at += content[at : at + 1] == b"\n"


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def warc_date(arc_date: str) -> str:
    """An ARC date of 14 digits (or the first of them) as a WARC date."""
    digits = (re.sub(r"\D", "", arc_date) + "19700101000000"[len(arc_date) :])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def record_id(url: str, page_id: int | None, date: str, digest: str) -> str:
    """The same identifier whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {date} {digest} {url}')}>"


def warc_response(record: dict) -> tuple[bytes, dict]:
    """A WARC response for an ARC record, and what is known of it."""
    fields, payload = split_http(record["block"])
    page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
    known = {"page_id": page_id, "url": record["url"], "date": warc_date(record["date"]), "digest": _digest(payload), "bytes": len(payload)}
    head = {"WARC-Type": "response", "WARC-Record-ID": record_id(known["url"], page_id, known["date"], known["digest"]), "WARC-Date": known["date"], "WARC-Target-URI": known["url"], "WARC-IP-Address": record["ip"], "WARC-Payload-Digest": known["digest"], "WARC-Block-Digest": _digest(record["block"]), "X-Page-Id": page_id, "Content-Type": "application/http; msgtype=response"}
    return _record(head, record["block"]), known


def warc_revisit(known: dict, refers_to: int) -> bytes:
    """A WARC revisit of the page whose response has the same payload."""
    head = {"WARC-Type": "revisit", "WARC-Record-ID": record_id(known["url"], known["page_id"], known["date"], known["digest"]), "WARC-Date": known["date"], "WARC-Target-URI": known["url"], "WARC-Payload-Digest": known["digest"], "WARC-Profile": REVISIT_PROFILE, "X-Page-Id": known["page_id"], "X-Refers-To-Page-Id": refers_to, "X-Payload-Length": known["bytes"], "Content-Type": "application/http; msgtype=response"}
    return _record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def read_warc(content: bytes):
    """The records of a WARC file, gzip members or plain, as (header fields in lower case, block)."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = content[stop + 4 : stop + 4 + size]
        if len(block) != size:
            raise ValueError("a WARC file ends within a record")
        yield head, block
        at = stop + 4 + size + 4


def to_arc(pages: DataFrame, date: str = "19990101000000") -> DataFrame:
    """Pages (page_id, url, html) as legacy archives of some megabytes: name, version, content. Versions take turns."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            html = pc.fill_null(batch.column(2), "").cast(pa.binary())
            held, size = [], 0
            for page_id, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, strict=True):
                held.append((page_id, url, payload.as_py()))
                size += len(held[-1][2])
                if size >= ARCHIVE_BYTES:
                    yield _archive(held, part, made, date)
                    held, size, made = [], 0, made + 1
            if held:
                yield _archive(held, part, made, date)
                made += 1

    return pages.select(F.col("page_id").cast("long"), "url", "html").transform(in_batches, run, "name string, version int, content binary")


def _archive(held: list, part: int, made: int, date: str) -> pa.RecordBatch:
    version, name = 1 + made % 2, f"legacy-{part:06d}-{made:05d}.arc"
    return pa.record_batch([pa.array([name]), pa.array([version], pa.int32()), pa.array([write_arc(held, version, name, date)], pa.binary())], names=["name", "version", "content"])


_KNOWN = "page_id long, url string, date string, digest string, bytes long"


def _known_batch(rows: list[dict], extra: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "url": pa.string(), "date": pa.string(), "digest": pa.string(), "bytes": pa.int64()}
    columns = {k: pa.array([r[k] for r in rows], t) for k, t in types.items()} | (extra or {})
    return pa.record_batch(list(columns.values()), names=list(columns))


def convert(arcs: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write WARC files of the records of ARC archives (content); returns their URIs (uri).

    Of records with equal payloads of at least ``least`` bytes that of the largest page_id becomes the response, the
    others revisit it; all others are responses. A null page_id revisits, unless no record of its payload has an id.
    Records repeated with that largest id stay responses. Empty input gives no file. Archives are parsed twice, for digests
    and for records; only records that may have equals are dealt by digest with their bodies.
    """
    spark = arcs.sparkSession
    folder = folder or new_path(spark, "warc")
    content = stored(arcs.select("content"), "arcs", 32 << 20)  # read twice

    def digests(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for r in read_arc(archive.as_py()):
                    fields, payload = split_http(r["block"])
                    if len(payload) >= least:
                        rows.append((int(fields["x-page-id"]) if "x-page-id" in fields else None, _digest(payload)))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["page_id", "digest"])

    # Digests that occur more than once, and a filter of fixed size that tells nearly all other records apart.
    counted = content.transform(in_batches, digests, "page_id long, digest string").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    repeated = stored(counted.filter("n > 1").select("digest", "refers_to"), "repeated")
    bits = spark.sparkContext.broadcast(bit_filter(repeated.select(F.crc32(F.col("digest").cast("binary")).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("place"))))

    class Files:
        """Members gathered into files of a task."""

        def __init__(self):
            from pyspark import TaskContext

            self.part, self.kind, self.held, self.size, self.made = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], 0, 0

        def add(self, member: bytes) -> list[str]:
            self.held.append(member)
            self.size += len(member)
            return self.flush() if self.size >= ARCHIVE_BYTES else []

        def flush(self) -> list[str]:
            if not self.held:
                return []
            uri = f"{folder}/part-{self.part:06d}-{self.made:05d}-{self.kind}.warc.gz"
            write_bytes(uri, b"".join(self.held))
            self.held, self.size, self.made = [], 0, self.made + 1
            return [uri]

    def written(uris: list[str]) -> pa.RecordBatch:
        empty = {k: None for k in ("page_id", "url", "date", "digest", "bytes")}
        return _known_batch([empty] * len(uris), {"member": pa.array([None] * len(uris), pa.binary()), "uri": pa.array(uris, pa.string())})

    def responses(batches):
        """Records without an equal are written here and now; the others go on with their bodies."""
        files = Files()
        for batch in batches:
            for archive in batch.column(0):
                rows, members, size, uris = [], [], 0, []
                for r in read_arc(archive.as_py()):
                    whole, known = warc_response(r)
                    member = gzip.compress(whole, 6, mtime=0)
                    if known["bytes"] < least or not maybe(bits.value, np.array([zlib.crc32(known["digest"].encode()) & (FILTER_BITS - 1)]))[0]:
                        uris += files.add(member)
                        continue
                    rows.append(known)
                    members.append(member)
                    size += len(member)
                    if size >= 1 << 20:
                        yield _known_batch(rows, {"member": pa.array(members, pa.binary()), "uri": pa.array([None] * len(rows), pa.string())})
                        rows, members, size = [], [], 0
                if rows:
                    yield _known_batch(rows, {"member": pa.array(members, pa.binary()), "uri": pa.array([None] * len(rows), pa.string())})
                if uris:
                    yield written(uris)
        yield written(files.flush())

    first = stored(content.transform(in_batches, responses, f"{_KNOWN}, member binary, uri string"), "records", 32 << 20)
    joined = first.filter("uri IS NULL").drop("uri").join(repeated, "digest", "left")

    def write(batches):
        files = Files()
        for batch in batches:
            for r in batch.to_pylist():
                revisit = r["refers_to"] is not None and r["refers_to"] != r["page_id"]
                uris = files.add(gzip.compress(warc_revisit(r, r["refers_to"]), 6, mtime=0) if revisit else r["member"])
                if uris:
                    yield pa.record_batch([pa.array(uris, pa.string())], names=["uri"])
        yield pa.record_batch([pa.array(files.flush(), pa.string())], names=["uri"])

    out = stored(joined.transform(in_batches, write, "uri string").union(first.filter("uri IS NOT NULL").select("uri")), "warc-files")
    bits.destroy()
    discard(content, repeated, first)
    return out


def read_back(files: DataFrame) -> DataFrame:
    """The records of WARC files (uri): page_id, payload_bytes, payload_digest (hex), record_type, refers_to.

    A response's size and digest come from its payload, which has to agree with the digest declared.
    """
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for head, block in read_warc(read_bytes(uri)):
                    digest, size = head["warc-payload-digest"], head.get("x-payload-length")
                    if head["warc-type"] == "response":
                        payload = split_http(block)[1]
                        size = len(payload)
                        if _digest(payload) != digest:
                            raise ValueError(f"a payload differs from its digest in {uri}")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), int(size), _hex(digest), head["warc-type"], number("x-refers-to-page-id")))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.repartition(n, "uri").transform(in_batches, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

"""WARC archives, index first.

Writing yields an index row (archive, offset, length, URL, digest) per record.  Reading
starts from selected index rows: they are sorted by archive and offset, near ranges are
coalesced into one read, and the records are cut out of the bytes.  Records with equal
payloads of some size are stored once; the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, bounded_batches, filesystem, partitions

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than GAP are read together, up to READ bytes at a time.
GAP, READ = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string, refers_to long"


#: Stands for a null page_id; no whole number of 64 bits has this form.
_NO_PAGE = 1 << 100


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NO_PAGE if page_id is None else page_id & (2**128 - 1))}>"


def _page(urn: str) -> int | None:
    value = uuid.UUID(urn[10:-1]).int
    if value == _NO_PAGE:
        return None
    return value - 2**128 if value >> 127 else value


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member.  A revisit (refers_to is set) keeps the HTTP head and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, digest, record_type, refers_to; checks the digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": length,
        "digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out, path, at, fs, root = TaskContext.get().partitionId(), 0, None, "", 0, None, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, size, digest, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "n", "digest", "refers_to")], strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        if fs is None:
                            fs, root = filesystem(folder)
                            fs.create_dir(root, recursive=True)
                        name = f"part-{part:06d}-{made:04d}-{uuid.uuid4().hex[:12]}.warc.gz"
                        made, at, path = made + 1, 0, f"{folder}/{name}"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(page_id, url, html or b"", size, digest, refers_to)
                    out.write(member)
                    rows.append((page_id, path, at, len(member), url, digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, folder: str, tables: Tables) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the saved index.

    Of rows with equal payloads of REVISIT_BYTES or more, those with the largest page_id are responses and the
    others revisits of it; rows with a null page_id are all responses and come back as null.  Null html is an empty
    payload, a null URL about:blank; extra columns are left out.  No rows: no archives and no records.
    Archive names are unique to the attempt that wrote them, so a task that runs twice leaves a stray file only.
    """
    bounded_batches(pages)
    bytes_ = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select("page_id", "url", bytes_.alias("payload")).withColumns({"n": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    sizes = tables.save(rows.select("page_id", "n", "digest"))
    shared = sizes.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1")
    later = tables.save(shared.select("digest", "top"))
    # the few columns of copied rows meet their digest here, the payloads later by the unique page
    revisits = tables.save(
        sizes.where(F.col("n") >= REVISIT_BYTES).join(later, "digest").where("page_id < top").select("page_id", "digest", F.col("top").alias("refers_to")).distinct()
    )
    marked = rows.join(revisits, ["page_id", "digest"], "left")
    slim = marked.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n", "digest", "refers_to")
    return tables.save(slim.mapInArrow(_write(folder), INDEX))


def _ranges(rows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(start, end, rows) of coalesced reads over sorted (offset, length, place)."""
    group: list[tuple[int, int, int]] = []
    start = end = 0
    for row in rows:
        if group and (row[0] - end > GAP or row[0] + row[1] - start > READ):
            yield start, end, group
            group = []
        if not group:
            start = row[0]
        group.append(row)
        end = max(end, row[0] + row[1]) if len(group) > 1 else row[0] + row[1]
    if group:
        yield start, end, group


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, handle = None, None
    for batch in batches:
        rows = list(zip(batch.column("archive").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            if rows[at][0] != path:
                if handle is not None:
                    handle.close()
                path = rows[at][0]
                fs, name = filesystem(path)
                handle = fs.open_input_file(name)
            for start, end, group in _ranges([(o, n, k) for k, (_, o, n) in enumerate(rows[at:to])]):
                data = handle.read_at(end - start, start)
                found = [parse(data[o - start : o - start + n]) for o, n, _ in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[c] for f in found], k) for c, k in (("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))],
                    ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )
            at = to
    if handle is not None:
        handle.close()


def read(index: DataFrame) -> DataFrame:
    """The records of the given index rows, in any order: page_id, url, payload binary (null for a revisit),
    payload_bytes long, payload_digest string, record_type string, refers_to long.  No rows: no records."""
    rows = index.select("archive", "offset", "length").repartition(partitions(index.sparkSession), "archive")
    return rows.sortWithinPartitions("archive", "offset").mapInArrow(_read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")

"""WARC archives: a writer with payload revisits, and a salvage reader.

The writer makes one gzip member per record; records whose payload equals an
earlier one are ``revisit`` records that refer to it.  The reader checks every
member and record (gzip CRC, header, length, digests); where a check fails it
searches for the next byte at which a valid member or version line begins,
goes on from there, and logs the bytes between as a quarantined gap.  Within a
member it searches the content for the next version line, up to the damage if the
member is damaged; of a member with broken data or checksum only records
whose digest holds are taken.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table_dir
from . import common as C

FILE_BYTES = 8 << 20
_GZ = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_END = b"\r\n\r\n"
#: Compressed bytes taken at a time: the first, and the most.
STEPS = 1 << 12, 1 << 20
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def check_digest(said: str | None, data: bytes) -> bool | None:
    """Whether a digest, in hex or base32, holds; None if its algorithm is unknown or there is none."""
    label, _, value = (said or "").strip().rpartition(":")
    label, value = label.strip().lower().replace("-", ""), value.strip()
    if not label and re.fullmatch("[0-9a-fA-F]{40}|[2-7a-zA-Z]{32}", value):
        label = "sha1"
    if label not in DIGESTS:
        return None
    true = hashlib.new(label, data).digest()
    return value.lower() == true.hex() or value.rstrip("=").upper() == base64.b32encode(true).decode().rstrip("=")


def record_bytes(kind: str, page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record, uncompressed.  A revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {name(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + _END + block + _END


def member(record: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record that begins at ``at`` and the byte after it; None if a check
    fails.  ``checked`` says whether a digest of a known algorithm held; a SHA-1 in
    ``digest`` is bare upper-case base32, others are as given."""
    if not _VERSION.match(data, at):
        return None
    cut = data.find(_END, at)
    if cut < 0:
        return None
    h = _headers(data[at:cut])
    length = h.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    begin, end = cut + 4, cut + 4 + int(length)
    block = data[begin:end]
    if len(block) != int(length) or data[end:end + 4] != _END:
        return None
    block_ok = check_digest(h.get("warc-block-digest"), block)
    if block_ok is False:
        return None
    rec = {"type": h.get("warc-type"), "id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"),
           "refers_to": h.get("warc-refers-to"), "digest": _bare(h.get("warc-payload-digest"))}
    payload, n = block, len(block)
    if h.get("content-type", "").startswith("application/http"):
        http, sep, payload = block.partition(_END)
        n = _headers(http).get("content-length", "")
        n = int(n) if n.isascii() and n.isdigit() else len(payload)
    payload_ok = None
    if rec["type"] == "revisit":
        payload = None
    elif rec["digest"] is None:
        rec["digest"] = digest(payload)
    else:
        payload_ok = check_digest(h["warc-payload-digest"], payload)
        if payload_ok is False:
            return None
    return rec | {"payload": payload, "payload_bytes": n, "checked": bool(block_ok or payload_ok)}, end + 4


def _bare(said: str | None) -> str | None:
    label, _, value = (said or "").strip().rpartition(":")
    if label.strip().lower().replace("-", "") not in ("", "sha1"):
        return said
    value = value.strip()
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode()
    return (value.upper() if re.fullmatch("[2-7a-zA-Z]{32}", value) else value) or None


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Of the gzip member at ``at``: its content, up to the damage if there is
    any, the byte after that, and ``whole``, ``cut`` (the archive ends in it) or ``broken``."""
    view, d, out, step = memoryview(data), zlib.decompressobj(31), [], STEPS[0]
    while at < len(data):
        before = d.copy()
        try:
            out.append(d.decompress(view[at:at + step]))
        except zlib.error:
            # once more, byte by byte, as the call that fails gives nothing
            for at in range(at, min(len(data), at + step)):
                try:
                    out.append(before.decompress(view[at:at + 1]))
                except zlib.error:
                    break
            return b"".join(out), at + 1, "broken"
        at = min(len(data), at + step)
        if d.eof:
            return b"".join(out), at - len(d.unused_data), "whole"
        step = min(2 * step, STEPS[1])
    return b"".join(out) + d.flush(), at, "cut"


def _content(inner: bytes, state: str) -> Iterator[dict]:
    """Records and gaps of a member's content.  A gap has ``inner_offset`` and
    ``inner_length``, its bytes in the content; the last of a damaged member may have none."""
    pos = bad = 0
    while pos < len(inner):
        one = parse_record(inner, pos)
        if one is None or state == "broken" and not one[0]["checked"]:
            m = _VERSION.search(inner, pos + 1)
            pos = m.start() if m else len(inner)
            continue
        if pos > bad:
            yield {"kind": "gap", "inner_offset": bad, "inner_length": pos - bad}
        yield one[0] | {"kind": "record"}
        pos = bad = one[1]
    if pos > bad or state != "whole":
        yield {"kind": "gap", "inner_offset": bad, "inner_length": pos - bad}


def _unit(data: bytes, at: int) -> tuple[list[dict], int, bool]:
    """Records and gaps of the member at ``at``, or the plain record there; the
    byte after it, or from which to search on; and whether it holds a record or is an empty member."""
    if data[at:at + 3] == _GZ:
        inner, end, state = _member(data, at)
        rows = list(_content(inner, state))
        if any(r["kind"] == "record" for r in rows) or not rows:
            return rows, end, True
        return [], end if state == "whole" else at + 1, False
    one = parse_record(data, at)
    return ([one[0] | {"kind": "record"}], one[1], True) if one else ([], at + 1, False)


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, with ``kind`` ``record`` or ``gap``,
    ``offset`` and ``length`` (bytes in the archive).  What lies in a member has the
    member's ``offset`` and ``length``, a gap there also its place in the content
    (``inner_offset``, ``inner_length``)."""
    at = bad = 0
    while at < len(data):
        rows, end, good = _unit(data, at)
        if not good:
            m = _START.search(data, end)
            at = m.start() if m else len(data)
            continue
        if at > bad:
            yield {"kind": "gap", "offset": bad, "length": at - bad}
        for r in rows:
            yield r | {"offset": at, "length": end - at}
        at = bad = end
    if at > bad:
        yield {"kind": "gap", "offset": bad, "length": at - bad}


def _page(name: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:(.+)>", name or "")
    return m and m[1]


def plan_records(df: DataFrame, id_col: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``_rr_id``, ``_rr_url``, ``_rr_payload`` and ``_rr_first``: the id that a
    revisit refers to, null for a response.

    Of rows with equal payloads of ``min_bytes`` or more the smallest id is
    the response.  Digests are grouped map-side first; the join back on them
    is left to the adaptive skew split.
    """
    rows = df.select(F.col(id_col).alias("_rr_id"), F.col(url).cast("string").alias("_rr_url"),
                     F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_rr_payload"))
    rows = rows.withColumn("_rr_sha", F.sha1("_rr_payload"))
    # ids alone: the payload is read again below and shuffled once
    least = rows.groupBy("_rr_sha").agg(F.min("_rr_id").alias("_rr_least"))
    revisit = (F.octet_length("_rr_payload") >= min_bytes) & ~F.col("_rr_id").eqNullSafe(F.col("_rr_least"))
    return (rows.join(least, "_rr_sha")
            .select("_rr_id", "_rr_url", "_rr_payload", F.when(revisit, F.col("_rr_least")).alias("_rr_first"),
                    revisit.alias("_rr_revisit")))


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
               min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row into ``path`` (a folder that all executors
    share) and return the written table of files (``file``, ``records``, ``bytes``).

    A null payload is empty; a null id is written as an empty id (a row
    with a null id revisits the smallest id, if any); rows that repeat the smallest
    id of a payload are all responses; other columns are ignored; an empty
    table writes no file.  A task's files are named by its partition, written
    aside and moved into place with rows in a fixed order, so a task that
    runs again writes the same files.
    """
    rows = plan_records(df, id_col, url, payload, min_bytes).sortWithinPartitions("_rr_id", "_rr_first", "_rr_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        made: list[tuple[str, int, int]] = []
        buf, n = bytearray(), 0

        def flush():
            name = f"part-{task.partitionId():06d}-{len(made):05d}.warc.gz"
            aside = f"{base}/_aside-{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as f:
                f.write(bytes(buf))
            store.move(aside, f"{base}/{name}")
            made.append((name, n, len(buf)))

        for b in batches:
            for i in range(b.num_rows):
                page, uri, body, first, again = (b.column(k)[i].as_py() for k in range(5))
                buf += member(record_bytes("revisit" if again else "response", page, uri, body, first))
                n += 1
                if len(buf) >= file_bytes:
                    flush()
                    buf, n = bytearray(), 0
        if n:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in
                                          enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["file", "records", "bytes"])

    return C.materialize(rows.mapInArrow(run, "file string, records long, bytes long"))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Salvage all ``*.warc`` and ``*.warc.gz`` archives under ``path``.

    One row per record (``kind`` ``record``) or quarantined gap (``gap``):
    ``file``, ``offset``, ``length``, ``record_type``, ``record_id``, ``uri``,
    ``refers_to``, ``payload_digest``, ``payload_bytes``, ``payload``, and of a
    gap within a member ``inner_offset`` and ``inner_length`` (see ``salvage``).  A
    file is one task's work, at most 2 GB.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content"))
    names = ["kind", "file", "offset", "length", "record_type", "record_id", "uri", "refers_to", "payload_digest",
             "payload_bytes", "payload", "inner_offset", "inner_length"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, out, size = b.column(0)[i].as_py(), [], 0
                for r in salvage(b.column(1)[i].as_py()):
                    body = r.get("payload") if with_payload else None
                    out.append((r["kind"], file, r["offset"], r["length"], r.get("type"), r.get("id"), r.get("uri"),
                                r.get("refers_to"), r.get("digest"), r.get("payload_bytes"), body,
                                r.get("inner_offset"), r.get("inner_length")))
                    size += len(body or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return files.mapInArrow(run, "kind string, file string, offset long, length long, record_type string, "
                            "record_id string, uri string, refers_to string, payload_digest string, "
                            "payload_bytes long, payload binary, inner_offset long, inner_length long")


def page_number(urn: str):
    """Column: the page id (long) in a ``<urn:page:...>`` name."""
    return F.regexp_extract(F.col(urn), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared checkpoint folder."""
    return scratch_table_dir(spark, f"warc-{uuid.uuid4().hex}")

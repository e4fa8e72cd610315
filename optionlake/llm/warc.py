"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Records are gzip members in files of bounded size under a folder that all executors share. Of
records with equal payloads of at least ``least`` bytes, the one with the largest id is the
response and the others refer to it; a revisit repeats digest and length, not the payload.

The reader takes each file member by member and each member record by record. After a failed check
(no member or version line, a broken stream, bad header, wrong length or digest) it looks for the
next member or version line that gives a valid record, goes on from there, and logs the bytes
between as a quarantined gap. Valid records of a damaged member are kept: those around a bad record,
those before a cut, and of a member whose stream is broken those whose digest agrees. Gaps are byte
ranges of the file; for a bad record inside a compressed member it is the member's range, and the
reason names the decoded bytes.

Archives of other writers are read too: every record needs a version line and Content-Length only.
page_id and refers_to are null where an id is not one of this writer's. Block and payload digests
are checked where they are SHA-1; the payload of an HTTP message begins after its headers. An
archive may hold at most 2 GB, the bound of Spark's binary file source.

Null payloads are empty, a null id is kept as an empty field and read back as null; rows that
repeat are written each, and share one response id. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
_MAGIC = b"\x1f\x8b\x08"
_FEED = 1 << 14
_PAGE = re.compile("<urn:page:([0-9-]+)>")
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, target string, payload binary, record_id string, refers_to_id string")
GAP = "file string, gap_start long, gap_end long, reason string"


def marked(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html and ``original``: the id that a record refers to, or null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    size = F.octet_length("html")
    last = rows.filter(size >= least).groupBy("digest").agg(F.max("page_id").alias("last"),
                                                           F.count("*").alias("n"))
    shared = last.filter("n > 1").select("digest", "last")
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when((F.col("page_id") != F.col("last")) | F.col("page_id").isNull(),
                                         F.col("last")).alias("original"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """One record; a revisit has no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if original is None else "revisit"
    body = payload if original is None else b""
    head = {"WARC-Type": kind, "WARC-Record-ID": _name(page_id),
            "WARC-Target-URI": "".join((url or "").splitlines()),
            "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload)),
            "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}
    if original is not None:
        head["WARC-Refers-To"] = _name(original)
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _writer(folder: str, file_bytes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, number, parts, size = TaskContext.get(), 0, [], 0

        def close() -> pa.RecordBatch:
            # a repeated attempt replaces the same file as a whole
            path = f"{root}/part-{task.partitionId():05d}-{number:05d}.warc.gz"
            draft = f"{root}/.draft-{task.taskAttemptId()}-{number}"
            with store.open_output_stream(draft, compression=None) as file:
                for part in parts:
                    file.write(part)
            store.move(draft, path)
            return pa.record_batch({"file": [path], "bytes": [size], "records": [len(parts)]})

        for batch in batches:
            for row in zip(*(batch.column(k) for k in ("page_id", "url", "html", "original")),
                           strict=True):
                page_id, url, html, original = (v.as_py() for v in row)
                parts.append(member(record(page_id, url, html.encode(), original)))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield close()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield close()
    return build


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0,
                   file_bytes: int = 32 << 20) -> DataFrame:
    """Writes the archives under ``folder`` (a URI) and returns file, bytes, records."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root)
    written = marked(pages, least).mapInArrow(_writer(uri, file_bytes),
                                              "file string, bytes long, records long")
    return spark.createDataFrame(written.toArrow())


def _headers(block: bytes) -> dict[str, str] | None:
    lines = block.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    pairs = [line.decode("utf-8", "replace").partition(":") for line in lines[1:] if line]
    return {k.lower(): v.strip() for k, _, v in pairs}


def _page(name: str | None) -> int | None:
    found = _PAGE.fullmatch(name or "")
    return int(found[1]) if found else None


def _agrees(stated: str | None, block: bytes) -> bool | None:
    """Whether a stated SHA-1 (base 32 or hexadecimal) is that of the bytes; None if none is stated."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    found = hashlib.sha1(block)
    return value.upper() in (base64.b32encode(found.digest()).decode(), found.hexdigest().upper())


def parse(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, its end, "") for a valid plain record at ``at``; else (None, at, reason).

    ``checked`` in the record tells whether a digest was compared.
    """
    cut = data.find(b"\r\n\r\n", at)
    head = _headers(data[at:cut]) if cut >= 0 else None
    if head is None:
        return None, at, "no version line or unfinished header"
    try:
        size = int(head["content-length"])
        full = int(head["x-payload-length"]) if "x-payload-length" in head else None
        kind = head["warc-type"].lower()
    except (KeyError, ValueError):
        return None, at, "bad header"
    end = cut + 4 + size
    if size < 0 or data[end:end + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    block = payload = data[cut + 4:end]
    if head.get("content-type", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    stated = head.get("warc-payload-digest")
    whole = _agrees(head.get("warc-block-digest"), block)
    part = None if kind == "revisit" else _agrees(stated, payload)
    if whole is False or (part is False and not whole) or (
            kind == "response" and full not in (None, len(payload))):
        return None, at, "wrong digest"
    digest = (stated or "").partition(":")[2] or (None if kind == "revisit" else base64.b32encode(
        hashlib.sha1(payload).digest()).decode())
    name, refers = head.get("warc-record-id"), head.get("warc-refers-to")
    return {"page_id": _page(name), "payload_bytes": len(payload) if full is None else full,
            "payload_digest": digest, "record_type": kind, "refers_to": _page(refers),
            "target": head.get("warc-target-uri"), "record_id": name, "refers_to_id": refers,
            "payload": None if kind == "revisit" else payload,
            "checked": bool(whole or part)}, end + 4, ""


def _next_start(data: bytes, at: int) -> int:
    found = [x for x in (data.find(_MAGIC, at), data.find(b"WARC/1.", at)) if x >= 0]
    return min(found, default=len(data))


def _decoded(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(decoded bytes, end of the member, reason if it is damaged) of the gzip member at ``at``."""
    unpack, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and fed < len(data):
            before = unpack.copy()
            parts.append(unpack.decompress(data[fed:fed + _FEED]))
            fed += _FEED
    except zlib.error as error:
        # what comes before the fault, byte by byte
        try:
            for k in range(fed, min(fed + _FEED, len(data))):
                parts.append(before.decompress(data[k:k + 1]))
        except zlib.error:
            pass
        return b"".join(parts), at, f"broken member: {error}"
    end = min(fed, len(data)) - len(unpack.unused_data)
    return b"".join(parts), end, "" if unpack.eof else "unfinished member"


def _inside(plain: bytes) -> Iterator[tuple[dict | None, int, int, str]]:
    """(record or None, start, end, reason) over decoded bytes, which it covers without a gap."""
    at, bad, reason = 0, None, ""
    while at < len(plain):
        row, end, why = parse(plain, at)
        if row is None:
            bad, reason = (at, why) if bad is None else (bad, reason)
            at = plain.find(b"WARC/1.", at + 1)
            at = len(plain) if at < 0 else at
            continue
        if bad is not None:
            yield None, bad, at, reason
            bad = None
        yield row, at, end, ""
        at = end
    if bad is not None:
        yield None, bad, len(plain), reason


def salvage(data: bytes) -> Iterator[tuple[dict | None, tuple[int, int, str] | None]]:
    """(record, None) or (None, gap) in file order; a gap is (start, end, reason)."""
    at, gap, reason = 0, None, ""
    kept: set[bytes] = set()  # records of the damaged member, whose bytes may lie open in the file
    while at < len(data):
        rows, end, why, inner = [], at, "no member or version line", []
        if data.startswith(_MAGIC, at):
            plain, end, why = _decoded(data, at)
            found = list(_inside(plain))
            rows = [row for row, *_ in found
                    if row and (not why.startswith("broken") or row["checked"])]
            inner = [f"decoded bytes {a} to {b}: {r}" for row, a, b, r in found if row is None]
            if why:
                kept |= {hashlib.sha1(plain[a:b]).digest() for row, a, b, _ in found if row}
            elif not found:
                why = "empty member"
        elif data.startswith(b"WARC/1.", at):
            row, end, why = parse(data, at)
            rows = [row] if row else []
            if row and kept and hashlib.sha1(data[at:end]).digest() in kept:
                at = _next_start(data, end)
                continue
        if not why:
            kept.clear()
        if gap is not None and (rows or not why):
            yield None, (gap, at, reason)
            gap = None
        yield from ((row, None) for row in rows)
        if why:
            gap, reason = (at, why) if gap is None else (gap, reason)
            at = _next_start(data, at + 1)
            continue
        if inner:
            yield None, (at, end, "; ".join(inner))
        at = end
    if gap is not None:
        yield None, (gap, len(data), reason)


def _reader(want_gaps: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [c.split()[0] for c in (GAP if want_gaps else RECORD).split(", ")]
        kinds = {"payload": pa.binary(), "payload_digest": pa.string(), "record_type": pa.string(),
                 "target": pa.string(), "record_id": pa.string(),
                 "refers_to_id": pa.string(), "file": pa.string(), "reason": pa.string()}

        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch({k: pa.array([r[k] for r in rows], kinds.get(k, pa.int64()))
                                    for k in keys})

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[dict] = []
                size = 0
                for row, gap in salvage(content.as_py()):
                    if want_gaps and gap:
                        rows.append({"file": path.as_py(), "gap_start": gap[0], "gap_end": gap[1],
                                     "reason": gap[2]})
                    elif row and not want_gaps:
                        rows.append(row)
                        size += len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)
    return build


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").schema(
        "path string, modificationTime timestamp, length long, content binary").load(folder).select(
            "path", "content")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All valid records under a folder; revisits have no payload."""
    return _files(spark, folder).mapInArrow(_reader(False), RECORD)


def read_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The quarantined byte ranges under a folder: file, gap_start, gap_end, reason."""
    return _files(spark, folder).mapInArrow(_reader(True), GAP)

"""WARC archives: a writer that names equal payloads once, and a reader that salvages damaged files.

Archives are written and read by Spark, so any file system it knows will do. The reader checks each record's frame and
block digest. After a failed check it looks for the next gzip member or version line whose record passes the checks, and
reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import scratch_path, store

END = b"\r\n\r\n"
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
FILE_BYTES = 8 << 20
BROADCAST = 500_000  # repeated payloads (some 100 bytes each) whose digests are broadcast
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"
RECORD = "kind string, file string, start long, stop long, reason string, record_id string, type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
NO_DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value) -> str:
    """A header value on one line."""
    return "" if value is None else "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record_text(record_id: str, uri: str, payload: str, refers_to: str | None) -> str:
    """One record without its closing blank lines; a revisit has the HTTP header only and names the full payload's size and digest."""
    data = payload.encode()
    block = HTTP.format(len(data)) + ("" if refers_to else payload)
    raw = block.encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {NO_DATE}",
        f"WARC-Target-URI: {_field(uri)}", f"WARC-Payload-Digest: sha1:{sha1_base32(data)}", f"WARC-Block-Digest: sha1:{sha1_base32(raw)}",
        f"WARC-X-Payload-Length: {len(data)}",
        *([f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(raw)}",
    ]
    return "\r\n".join(head) + "\r\n\r\n" + block


def _page(value) -> str:
    return f"urn:x-page:{'' if value is None else int(value)}"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write a record per row of ``pages`` to files of about ``file_bytes`` below ``path``.

    Of equal payloads of at least ``min_bytes`` bytes, the one with the largest id is a response and the others are revisits
    of it; smaller payloads are all responses. A null html is an empty payload, a null URL an empty URI. Rows that repeat
    the largest id are all responses, as are rows of a group that has no id. A null id is written as an empty one.
    Other columns are ignored. An empty table gives no record.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha2("html", 256), "size": F.octet_length("html")})
    # a hot payload is summed in each task first; only payloads that repeat are joined back
    groups = store(rows.groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")))
    total = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    each = max(1, int(file_bytes * (total.n or 1) / max(1, (total.bytes or 0) + 600 * (total.n or 0))))
    shared = groups.filter((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("sha", "first")
    shared = store(shared)
    if shared.count() <= BROADCAST:  # else by shuffling the pages
        shared = F.broadcast(shared)
    known = rows.join(shared, "sha", "left").select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first"))
                                                    .when(F.col("page_id").isNull(), F.col("first")).alias("first"))

    def build(frames):
        for f in frames:
            refers = [None if x != x or x is None else _page(x) for x in f["first"]]
            ids = [None if x != x or x is None else x for x in f["page_id"]]
            yield f[["html"]].assign(html=[record_text(_page(i), u, h, r) for i, u, h, r in zip(ids, f["url"], f["html"], refers, strict=True)])

    # ids as text: pandas would turn a column with nulls into doubles
    known = known.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("first").cast("string").alias("first"))
    (known.mapInPandas(build, "html string").write.option("lineSep", END.decode()).option("compression", "none")
     .option("maxRecordsPerFile", each).text(path))


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line is at ``at``, and where it ends; ValueError if a check fails."""
    stop = data.find(END, at)
    if not data.startswith(VERSION, at) or stop < 0:
        raise ValueError("no version line or header end")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        raise ValueError("no length or type")
    begin, end = stop + 4, stop + 4 + int(head["content-length"])
    if data[end:end + 4] != END:
        raise ValueError("block length")
    block = data[begin:end]
    if (said := head.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != sha1_base32(block):
        raise ValueError("block digest")
    kind = head["warc-type"]
    payload = block.partition(END)[2] if head.get("content-type", "").startswith("application/http") else block
    whole, digest = len(payload), sha1_base32(payload)
    if kind == "revisit":
        whole, digest, payload = int(head.get("warc-x-payload-length") or 0), head.get("warc-payload-digest", "").removeprefix("sha1:"), None
    return {"record_id": head.get("warc-record-id", "").strip("<>"), "type": kind, "uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_bytes": whole, "payload_digest": digest, "payload": payload}, end + 4


def _member(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member at ``at``, and where it ends."""
    unpack = zlib.decompressobj(31)
    try:
        plain = unpack.decompress(data[at:])
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not unpack.eof:
        raise ValueError("gzip: cut short")
    found, pos = [], 0
    while pos < len(plain):
        record, pos = _parse(plain, pos)
        found.append(record)
    if not found:
        raise ValueError("empty member")
    return found, len(data) - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order, with the byte range each takes."""
    at, bad, reason = 0, None, None
    while at < len(data):
        try:
            records, stop = _member(data, at) if data.startswith(MEMBER, at) else ((r := _parse(data, at))[:1], r[1])
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            found = [p for p in (data.find(VERSION, at + 1), data.find(MEMBER, at + 1)) if p >= 0]
            at = min(found, default=len(data))
            continue
        if bad is not None:
            yield {"kind": "gap", "start": bad, "stop": at, "reason": reason}
            bad = None
        for r in records:
            yield {"kind": "record", "start": at, "stop": stop, **r}
        at = stop
    if bad is not None:
        yield {"kind": "gap", "start": bad, "stop": len(data), "reason": reason}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (``kind`` = record) and quarantined byte ranges (``kind`` = gap) of all archives below ``path``.

    An empty file gives nothing; one without a valid record gives a single gap. A task holds the files of its split.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]

    def parse(frames):
        import pandas as pd

        for f in frames:
            for file, data in zip(f["path"], f["content"], strict=True):
                rows = []
                for r in salvage(bytes(data)):
                    rows.append(r | {"file": file, **({} if payloads else {"payload": None})})
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(\d+|-\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read_archives(spark, path, payloads=False).filter("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))

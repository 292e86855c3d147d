"""WARC archives: writer with revisit records, and a salvage reader.

Each record is a gzip member of its own, so damage costs the records it hits and no
others. Members are written by Spark's own text writer, so archives go to any store
Spark can write to: a member ends with the highest byte of its 32-bit length, which is
zero below 16 MB, and that zero is the writer's line separator. Longer records go on in
further members. Of records with one payload that with the least id is a response, the
others are revisits without a payload.

The reader takes whole files and walks each: a record is good if its version line,
header, length, terminator and (for responses) payload digest hold. Where one fails,
or a gzip member does, it searches for the next member or version line from which a
record can be read, takes up there, and logs the bytes between as a quarantined gap.
A file is one row of at most 2 GB, so the writer splits archives by size.

Defined results: an empty table gives an empty result; a null payload is an empty one; equal ids with equal payloads are
all responses where they are the least; a null id comes after all others and reads
back as null; a null URI has no header, and control characters in it are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from reefpulse.llm.store import bounded_batches

END = b"\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
# Less than 2 ** 24, so that the length at a member's end has a zero on top.
MEMBER_BYTES = 1 << 23
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = (
    "path string, offset long, length long, problem string, id long, record_type string, refers_to long, uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)
_NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def payload_digest(hexed: Column) -> Column:
    """A SHA-1 in hex as base32: eight groups of 20 bits, four digits each.

    ``hexed`` should be a column of its own, so that the hash is computed once.
    """
    groups = [F.conv(F.substring(hexed, i * 5 + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[
        F.substring(F.lit(_BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for n in groups for s in (15, 10, 5, 0)
    ])


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))


def with_records(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """One WARC record per page as text, without its last two line breaks: page_id, size and record.

    Digests of payloads meet the least id of each in an equi-join that AQE splits
    where a payload is very common.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    known = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("uri"), payload.alias("payload"), F.sha1(payload).alias("hex"),
    )
    least = known.groupBy("hex").agg(F.min("id").alias("first"))
    both = known.join(least, "hex").withColumn("digest", payload_digest(F.col("hex")))
    again = ~F.col("id").eqNullSafe(F.col("first"))
    eol = "\r\n"
    uri = F.regexp_replace("uri", r"[\x00-\x20\x7f]", "%20")
    size = F.octet_length("payload")
    body = F.when(again, "").otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{eol}WARC-Record-ID: "), _urn(F.col("id")),
        F.lit(f"{eol}WARC-Date: 2024-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit(f"{eol}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{eol}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(
            F.lit(f"{eol}WARC-Refers-To: "), _urn(F.col("first")),
            F.lit(f"{eol}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit(f"{eol}X-Payload-Length: "), size.cast("string"),
        )).otherwise(""),
        F.lit(f"{eol}Content-Type: text/html{eol}Content-Length: "), F.octet_length(body).cast("string"), F.lit(eol + eol),
    )
    return both.select("id", size.alias("size"), F.concat(head, body).alias("value"))


def _members(record: bytes, size: int) -> bytes:
    """The record as gzip members of ``size`` bytes or less, without the zero at the end of the last."""
    out = []
    for at in range(0, len(record), size):
        packer = zlib.compressobj(wbits=31)
        out.append(packer.compress(record[at : at + size]) + packer.flush())
    return b"".join(out)[:-1]


def _packed(size: int):
    def run(records: pa.Array) -> pa.Array:
        return pa.array((_members(r.as_py() + END, size) for r in records), pa.binary())

    return run


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = 8 << 20,
    member_bytes: int = MEMBER_BYTES,
) -> None:
    """Writes gzipped archives of about ``file_bytes`` of payload each, or less, to the folder ``path``."""
    if not 0 < member_bytes < 1 << 24:
        raise ValueError("a member holds at least one byte and less than 16 MB")
    bounded_batches(pages.sparkSession)
    total, n = pages.agg(F.sum(F.octet_length(F.col(html))), F.count(F.lit(1))).first()
    most = max(1, file_bytes * n // max(total or 0, 1)) if n else 1
    records = with_records(pages, page_id, url, html)
    packed = records.select(arrow_udf(_packed(member_bytes), "binary")(F.col("value").cast("binary")).cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", most).text(path)


def _fields(header: bytes) -> dict[str, str]:
    found = {}
    for line in header.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line has no colon")
        found[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def _id(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _record(data: bytes, at: int) -> tuple[int, dict]:
    """The record at ``at`` and where it ends; ValueError says what does not hold."""
    if not _START.match(data, at):
        raise ValueError("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise ValueError("the header does not end")
    f = _fields(data[at:stop])
    if not f.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin = stop + len(END)
    end = begin + int(f["content-length"])
    if data[end : end + len(END)] != END:
        raise ValueError("the record does not end where its length says")
    payload, kind = data[begin:end], f.get("warc-type", "")
    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("the payload does not have its digest")
    size = f.get("x-payload-length", "")
    return end + len(END), {
        "id": _id(f.get("warc-record-id")), "record_type": kind, "refers_to": _id(f.get("warc-refers-to")), "uri": f.get("warc-target-uri"),
        "payload_bytes": int(size) if kind == "revisit" and size.isdigit() else len(payload), "payload_digest": digest, "payload": payload,
    }


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a gzip member yields, where it ends, and what is wrong with it.

    Of a part that fails, what its bytes ahead of the damage yield is kept.
    """
    out, d, step = [], zlib.decompressobj(31), 1 << 16
    for k in range(at, len(data), step):
        before = d.copy()
        try:
            out.append(d.decompress(data[k : k + step]))
        except zlib.error as e:
            try:
                for i in range(k, k + step):
                    out.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), -1, f"gzip: {e}"
        if d.eof:
            return b"".join(out), min(k + step, len(data)) - len(d.unused_data), ""
    return b"".join(out), len(data), "the gzip member does not end"


def _goes_on(text: bytes) -> bool:
    """Whether a record starts this member and, by its own length, does not end in it."""
    stop = text.find(END)
    if not _START.match(text) or stop < 0:
        return bool(_START.match(text))
    try:
        size = _fields(text[:stop]).get("content-length", "")
    except ValueError:
        return False
    return size.isdigit() and stop + len(END) + int(size) + len(END) > len(text)


def _joined_members(data: bytes, at: int) -> tuple[bytes, int, str]:
    """A member, with those after it that carry on its only record."""
    text, end, wrong = _member(data, at)
    while not wrong and data.startswith(_GZIP, end) and _goes_on(text):
        more, stop, bad = _member(data, end)
        if _START.match(more):
            break
        text, end, wrong = text + more, stop, bad
    return text, end, wrong


def _next(data: bytes, at: int) -> int:
    """Where the next version line is, or the next gzip member that starts with one."""
    line = _START.search(data, at)
    stop = line.start() if line else len(data)
    mark = data.find(_GZIP, at, stop)
    while mark >= 0:
        try:
            if _START.match(zlib.decompressobj(31).decompress(data[mark : mark + 4096], 64)):
                return mark
        except zlib.error:
            pass
        mark = data.find(_GZIP, mark + 1, stop)
    return stop


def salvage(data: bytes) -> Iterator[dict]:
    """Records of one archive, plain or gzipped, and its quarantined gaps.

    Offsets count in the file; those of what is inside a gzip member count in the
    member's own bytes, and a gap there says so.
    """
    at = gap = 0
    why = ""
    while at < len(data):
        try:
            if data.startswith(_GZIP, at):
                text, end, wrong = _joined_members(data, at)
                if wrong and not _START.match(text):
                    raise ValueError(wrong)
                end = _next(data, at + 1) if wrong else end
                found = list(salvage(text))
                if wrong:
                    found = [r for r in found if "problem" not in r] + [{"offset": at, "length": end - at, "problem": wrong}]
                else:
                    found = [r | {"problem": f"in the member at {at}: {r['problem']}"} if "problem" in r else r for r in found]
            else:
                end, record = _record(data, at)
                found = [{"offset": at, "length": end - at} | record]
        except ValueError as e:
            why = why or str(e)
            at = _next(data, at + 1)
            continue
        if gap < at:
            yield {"offset": gap, "length": at - gap, "problem": why}
        yield from found
        at = gap = end
        why = ""
    if gap < len(data):
        yield {"offset": gap, "length": len(data) - gap, "problem": why}


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"path": pa.string(), "problem": pa.string(), "record_type": pa.string(), "uri": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.int64())) for n in _NAMES], _NAMES)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for row in salvage(content.as_py()):
                    row["path"] = path.as_py()
                    held += len(row.get("payload") or b"")
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    if held > 1 << 23:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records and gaps of the archives in ``path``; rows with a ``problem`` are gaps."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), RECORDS)

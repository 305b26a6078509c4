"""WARC archives of web pages: a writer that stores equal payloads once, and a reader that salvages damaged archives.

Archives hold one gzip member for each record. The reader walks through members (and through plain records of uncompressed
archives) and checks each; after a failed check it searches for the next place where a valid member or record begins, goes
on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.store import cut, tidy

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 0
#: Payload bytes of an archive, on average.
ARCHIVE_BYTES = 32 << 20
#: Records of one payload are written by so many tasks.
SALTS = 16
#: Records of about so many bytes are handed over at once.
BATCH_BYTES = 8 << 20
ID = "urn:x-page:"
#: The end of an archive's line in Spark's text writer, and the last byte of each member.
END = "\0"
EMPTY_MEMBER = zlib.compress(b"", 6, 31)
_GZIP, _PLAIN = b"\x1f\x8b\x08", b"WARC/1."
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
FOUND = "kind string, path string, offset long, length long, inner long, reason string, warc_type string, record_id string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ARROW = [("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner", pa.int64()), ("reason", pa.string()), *[(c, pa.string()) for c in ("warc_type", "record_id", "uri", "date", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary())]


def sha1_base32(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing --------------------------------------------------------------------------------------------------------


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def page_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """A response, or a revisit of the page refers_to: the HTTP head alone, which tells the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = sha1_base32(payload)
    block = http if refers_to is not None else http + payload
    name = ID + quote(page_id, safe="") if page_id is not None else f"{ID.replace('page', 'unnamed')}{digest}"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: quote(m[0]), url)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE.decode()), ("WARC-Refers-To", f"<{ID}{quote(refers_to, safe='')}>")]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _record(headers, block)


def member(record: bytes) -> bytes:
    """One gzip member whose last byte is 0: that of its length, or of an empty member behind it for records of 16 MB and more."""
    out = zlib.compress(record, 6, 31)
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def with_targets(pages: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(id string, url, html, refers string) of every page: the page that it revisits, null for those that are written in full.

    A first pass reduces payloads to digests and counts them (combined before the shuffle). Pages then meet the largest
    page_id of their digest, of those digests alone that occur more than once, in one shuffle by digest and a salt of the
    page_id, so a payload that a third of all pages hold is dealt over SALTS tasks. It has as many partitions as archives of
    archive_bytes on average are needed.
    """
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html).cast("long")
    seen = pages.select("page_id", F.unhex(F.sha1(html)).alias("sha"), size.alias("size"))
    digests = cut(seen.groupBy("sha", "size").agg(F.max("page_id").alias("target"), F.count("*").alias("n")))
    total = digests.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    parts = max(1, math.ceil(total / archive_bytes))
    copied = digests.where((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("target").isNotNull())
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    copied = copied.select("sha", "target", salts).repartition(parts, "sha", "salt")
    salt = F.pmod(F.hash("page_id"), F.lit(SALTS))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html)).alias("sha"), salt.alias("salt")).repartition(parts, "sha", "salt")
    found = rows.join(copied.hint("merge"), ["sha", "salt"], "left")
    # of repeated rows of the largest page_id one is written in full
    order = Window.partitionBy("sha", "salt", "page_id").orderBy("url")
    first = (F.col("page_id") == F.col("target")) & (F.row_number().over(order) == 1)
    refers = F.when(F.col("target").isNotNull() & ~F.coalesce(first, F.lit(False)), F.col("target").cast("string"))
    return found.select(F.col("page_id").cast("string").alias("id"), "url", "html", refers.alias("refers"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives of pages (page_id, url, html) to the folder path, with one record for each row.

    The payload is html in UTF-8 (null: empty). Of equal payloads of at least least_bytes the row of the largest page_id is
    a response (one, if it is repeated); the others are revisits of it. Rows without page_id never are what others revisit,
    so of payloads that only they hold each is a response. URLs may be null; control characters and spaces in them are
    percent-encoded. Other columns are ignored; an empty table gives an empty folder.

    Spark's text writer makes the files, so that any store will do: a member is a line whose end is its own last byte.
    """

    def run(batches):
        started, out, size = False, [], 0
        for batch in batches:
            ids, urls, htmls, refers = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                if not started:
                    started = True
                    out.append(member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{ID.replace('page', 'info')}0>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", "18")], b"format: WARC 1.1\r\n"))[:-1])
                out.append(member(page_record(ids[k].as_py(), urls[k].as_py(), htmls[k].as_py(), refers[k].as_py(), date))[:-1])
                size += len(out[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = with_targets(pages, least_bytes, archive_bytes).select("id", "url", F.encode("html", "utf-8").alias("html"), "refers")
    rows.mapInArrow(tidy(run), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).text(path)


# -- reading --------------------------------------------------------------------------------------------------------


class Damage(Exception):
    """A check that failed."""


def parse_record(data, at: int = 0) -> tuple[dict[str, str], memoryview, int]:
    """(headers in lower case, block, place behind the record) of the plain record at a place; raises Damage."""
    view = memoryview(data)
    if not _HEAD.match(data, at):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damage("headers do not end")
    headers: dict[str, str] = {}
    last = None
    for line in data[at:end].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:  # folded
            headers[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damage("malformed header")
        last = name.strip().lower().decode("utf-8", "replace")
        headers[last] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damage("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if stop + 4 > len(data):
        raise Damage("truncated block")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("content length")
    block = view[start:stop]
    _check_digest(headers.get("warc-block-digest"), block, "block digest")
    return headers, block, stop + 4


def _check_digest(stated: str | None, data, what: str) -> None:
    """Digests of other kinds than SHA-1 in base 32 are not checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1" and len(value) == 32 and sha1_base32(data) != value.upper():
        raise Damage(what)


def payload_of(headers: dict[str, str], block: memoryview) -> tuple[int | None, memoryview | None]:
    """(bytes of the full payload, payload as stored) of a record; a revisit has the length that its HTTP head states."""
    kind = headers.get("warc-type", "")
    if not headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return (None, None) if kind == "revisit" else (len(block), block)
    head = bytes(block[: 1 << 16])
    end = head.find(b"\r\n\r\n")
    if end < 0:
        raise Damage("HTTP head")
    if kind == "revisit":
        stated = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", head[:end], re.I)
        return (int(stated[1]) if stated else None), None
    body = block[end + 4 :]
    if kind == "response":
        _check_digest(headers.get("warc-payload-digest"), body, "payload digest")
    return len(body), body


def _bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri[:1] == "<" and uri[-1:] == ">" else uri


def _found(headers: dict[str, str], block: memoryview) -> dict:
    n, payload = payload_of(headers, block)
    digest = headers.get("warc-payload-digest")
    return {"kind": "record", "warc_type": headers.get("warc-type"), "record_id": _bare(headers.get("warc-record-id")), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "refers_to": _bare(headers.get("warc-refers-to")), "payload_digest": digest.partition(":")[2] if digest else None, "payload_bytes": n, "payload": payload}


def _inflate(data, at: int) -> tuple[bytes, int]:
    """(contents, place behind it) of the gzip member at a place; zlib checks its sum and length."""
    machine = zlib.decompressobj(31)
    try:
        out = machine.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise Damage("gzip check") from e
    if not machine.eof:
        raise Damage("truncated member")
    return out, len(data) - len(machine.unused_data)


def _plain(data, at: int) -> tuple[list[dict], int]:
    headers, block, end = parse_record(data, at)
    return [{"offset": at, "length": end - at, "inner": None, **_found(headers, block)}], end


def _member(data, at: int) -> tuple[list[dict], int]:
    """Records of the member at a place. A member of several records is salvaged like a plain archive; if no record in it is
    valid, the member is not."""
    text, end = _inflate(data, at)
    if not text:
        return [], end
    try:
        own, stop = _plain(text, 0)
        if stop == len(text):
            return [{**own[0], "offset": at, "length": end - at}], end
    except Damage as e:
        stop = None
        if text.find(_PLAIN, 1) < 0:
            raise e
    inside = list(salvage(text, nested=True))
    if not any(x["kind"] == "record" for x in inside):
        raise Damage(inside[0]["reason"])
    return [{**x, "offset": at, "length": end - at, "inner": x["offset"]} for x in inside], end


def salvage(data: bytes, nested: bool = False) -> Iterator[dict]:
    """Records and gaps of an archive in order: every byte lies in one of them (or in an empty member)."""
    at, n = 0, len(data)

    def take(place: int):
        if not nested and data.startswith(_GZIP, place):
            return _member(data, place)
        return _plain(data, place)

    while at < n:
        try:
            rows, end = take(at)
        except Damage as e:
            reason, place, got = str(e), at, None
            while got is None:
                nexts = [k for k in (data.find(_PLAIN, place + 1), -1 if nested else data.find(_GZIP, place + 1)) if k >= 0]
                if not nexts:
                    break
                place = min(nexts)
                try:
                    got = take(place)
                except Damage:
                    continue
            stop = n if got is None else place
            yield {"kind": "gap", "offset": at, "length": stop - at, "inner": None, "reason": reason}
            at = stop
            if got is None:
                break
            rows, end = got
        yield from rows
        at = end


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """What the archives in the folder path hold: rows of kind `record` and of kind `gap` (columns FOUND).

    offset and length are bytes of the file (of the whole member, if compressed); inner is the place in a member of several
    records. Records that fail a check (gzip sum, version line, headers, length, SHA-1 of block or payload) lie in gaps,
    with the reason. payload_digest is bare; payload_bytes counts the full payload, also for revisits. payload is filled
    only if asked for. Payloads are HTTP bodies as stored. Archives are read whole, one at a time in a task: at most 2 GB each.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [n for n, _ in _ARROW]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows, size = [], 0
                for x in salvage(data):
                    body = x.pop("payload", None)
                    x["path"] = name
                    if payloads and body is not None:
                        x["payload"] = bytes(body)
                        size += len(body)
                    rows.append(x)
                    if size >= BATCH_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _ARROW], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _ARROW], names)

    return files.mapInArrow(tidy(run), FOUND)


def page_records(found: DataFrame) -> DataFrame:
    """(page_id string, url, payload_bytes, payload_digest, record_type, refers_to string, payload) of responses and revisits that write_warc
    made, from what read_archives found."""
    named = lambda c: F.when(F.col(c).startswith(ID), F.substring(c, len(ID) + 1, 1 << 30))
    plain = lambda c: F.try_url_decode(c)
    rows = found.where("kind = 'record' and warc_type in ('response', 'revisit')").withColumns({"page_id": named("record_id"), "target": named("refers_to")})
    return rows.select(plain(F.col("page_id")).alias("page_id"), F.col("uri").alias("url"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), plain(F.col("target")).alias("refers_to"), "payload")


def unresolved(found: DataFrame) -> DataFrame:
    """(refers_to, n): records that revisits name but that were not recovered, and how many revisits lose their payload."""
    wanted = found.where("kind = 'record' and warc_type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("n"))
    there = found.where("kind = 'record' and warc_type = 'response'").select(F.col("record_id").alias("refers_to"))
    return wanted.join(there, "refers_to", "left_anti")

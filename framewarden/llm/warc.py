"""WARC archives: writing, reading, and reassembly of segmented records.

Writing. Each record is a header block, an HTTP block in chunked transfer framing, and the closing blank line. A payload
that is longer than a segment is cut into a first record and continuation records. Each record is a gzip member of its own,
or plain. The records are the lines of a text sink whose line end is the last byte of the record, so the files are WARC 1.1,
written by Spark wherever it can write. A chunk ends inside any place of a payload that holds the version text, so a plain
record holds its mark at its start only; so does a gzip member, whose header is the mark. By the mark Spark splits the files.

Reading. The reader splits files at the mark, parses headers, groups continuation records by the identifier of their
origin, orders them by segment number, verifies the total length, and takes the chunked framing off.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .staging import BROADCAST_ROWS, stage, text_batches

VERSION = b"WARC/1.1"
MARK = VERSION + b"\r\n"
#: The header of every gzip member: no time, no name, the version as its comment.
GZIP_MARK = b"\x1f\x8b\x08\x10\0\0\0\0\0\xff" + VERSION + b"\0"
SEGMENT = 1 << 20
CHUNK = 1 << 14
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records carry one date, so that the same table gives the same archive.
DATE = "2000-01-01T00:00:00Z"

RECORDS = "record_id string, warc_type string, headers map<string,string>, content binary, complete boolean"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in HTTP chunked transfer framing; the body holds the version text nowhere.

    It isn't enough to break the mark: a chunk or a segment that ends in the version text would be followed by a line end."""
    out, at = [], 0
    while at < len(payload):
        end = min(len(payload), at + size)
        # the version may also start in this chunk and end in the next: the framing between them breaks it
        found = payload.find(VERSION, at, end)
        if found >= 0:
            end = found + 1
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def member(record: bytes) -> bytes:
    """The record as one gzip member that holds the mark of members at its start only, and ends in a zero byte."""
    if len(record) >= 1 << 24:
        raise ValueError("a record is longer than 16 MB: take shorter segments")  # the last byte is the length's highest
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15, 9, strategy)
        body = deflate.compress(record) + deflate.flush()
        if GZIP_MARK not in body:
            return GZIP_MARK + body + zlib.crc32(record).to_bytes(4, "little") + len(record).to_bytes(4, "little")
    raise ValueError("the compressed record holds the mark of a gzip member")


def unpack(raw: bytes) -> bytes:
    """The record of a gzip member without its mark; b"" if it is damaged."""
    inflate = zlib.decompressobj(-15)
    try:
        record = inflate.decompress(raw) + inflate.flush()
    except zlib.error:
        return b""
    return record if inflate.unused_data == zlib.crc32(record).to_bytes(4, "little") + len(record).to_bytes(4, "little") else b""


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(content)))])
    return MARK + head.encode() + b"\r\n" + content + b"\r\n\r\n"


def clean(value: str | None) -> str:
    """A header value on one line, free of the mark."""
    return " ".join((value or "").split()).replace("WARC/1.1", "WARC 1.1")


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha1: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    uri = f"<urn:page:{page_id}:{sha1}>"
    common = [("WARC-Record-ID", uri), ("WARC-Target-URI", clean(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{sha1}>"), kind], http)
        return
    block = http + chunked(payload)
    # a segment ends inside a mark too: none is put together again by the cut, since the chunks hold none
    parts = [block[i : i + segment] for i in range(0, len(block), segment)] or [b""]
    for n, part in enumerate(parts, 1):
        more = [] if len(parts) == 1 else [("WARC-Segment-Number", str(n))]
        if n == 1:
            yield record([("WARC-Type", "response"), *common, *more, kind], part)
            continue
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{sha1}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", uri), *more], part)


def write_archives(pages: DataFrame, path: str, min_revisit: int = 1000, segment: int = SEGMENT, gzip: bool = True) -> None:
    """Write one record per row of pages (page_id, url, html) under ``path``; with ``gzip`` each is a gzip member.

    Of rows with equal payloads of at least ``min_revisit`` bytes the one with the largest page_id is a response, the
    others revisit it. Rows that repeat a page_id, or have none, are never revisits of themselves: they are responses. The
    identifier of a record is that of its page and payload, so rows that repeat both write the same record again.
    """
    text_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = base.withColumns({"sha1": F.sha1("payload"), "digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")})
    long = keyed.where(F.col("size") >= min_revisit)
    first = long.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = stage(first, "copied")
    if first.count() <= BROADCAST_ROWS // 8:  # a row has some 80 bytes: the payloads stay where they were read
        found = keyed.join(F.broadcast(first), "digest", "left")
    else:  # more digests have copies: then only payloads that may be copies are shuffled
        found = long.join(first.hint("merge"), "digest", "left").unionByName(keyed.where(F.col("size") < min_revisit).withColumn("response", F.lit(None).cast("long")))
    keeper = F.when((F.col("size") >= min_revisit) & (F.col("response") != F.col("page_id")), F.col("response"))
    marked = found.select("page_id", "url", "payload", "sha1", keeper.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns = (part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "sha1"))
                records = (r for row in zip(*columns, strict=True) for r in page_records(*row, segment=segment))
                out = [(member(r) if gzip else r)[:-1] for r in records]
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    # the text sink ends each line with the byte that the record was cut by
    marked.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0" if gzip else "\n").option("compression", "none").text(path)


def parse(raw: bytes) -> tuple[str | None, str | None, dict[str, str], bytes, bool]:
    """A record without its mark: id, type, headers, content, and whether the content is as long as it says."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        key, _, value = line.partition(":")
        headers[key.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    size = int(length) if length.isdigit() else -1
    return headers.get("warc-record-id"), headers.get("warc-type"), headers, rest[: max(size, 0)], 0 <= size <= len(rest)


def read_archives(spark: SparkSession, path: str, gzip: bool = True) -> DataFrame:
    """The records under ``path`` as they are in the files: record_id, warc_type, headers (names in lower case), content,
    complete (the content is as long as its header says). A damaged gzip member is a record of nulls, not complete."""
    # in this encoding the separator's characters are its bytes
    mark = (GZIP_MARK if gzip else MARK).decode("latin-1")
    lines = spark.read.option("lineSep", mark).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("content", pa.binary()), ("complete", pa.bool_())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                raw = batch.column(0).slice(at, 64).to_pylist()
                rows = [parse(unpack(r).removeprefix(MARK) if gzip else r) for r in raw]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.record_batch([pa.array([list(h.items()) for h in c] if i == 2 else c, schema[i].type) for i, c in enumerate(columns)], schema=schema)

    return lines.where("length(raw) > 0").mapInArrow(run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, warc_type, headers, content, complete): continuations joined to their origin.

    Segments of one origin are ordered by segment number; the record is complete if each segment is, the numbers run from
    1 without a gap, all as often, and the lengths add up to the total length that the last one states. Segments without
    their first are returned under the origin's id as type ``continuation``, not complete. Records that aren't segmented
    are not shuffled.
    """
    number = F.col("headers")["warc-segment-number"].cast("int")
    whole = records.where(number.isNull())
    parts = records.where(number.isNotNull()).select(
        F.coalesce(F.col("headers")["warc-segment-origin-id"], "record_id").alias("origin"),
        F.struct(
            number.alias("n"), F.col("headers")["warc-segment-total-length"].cast("long").alias("total"), "warc_type", "headers", "content", "complete"
        ).alias("part"),
    )
    # a record that was written k times has each of its segments k times
    each = parts.groupBy("origin", "part.n").agg(F.first("part").alias("part"), F.count("*").alias("copies"), F.countDistinct("part.content", "part.total").alias("kinds"))
    joined = each.groupBy("origin").agg(
        F.array_sort(F.collect_list("part"), lambda a, b: a["n"] - b["n"]).alias("parts"), F.min("copies").alias("copies"), ((F.min("copies") == F.max("copies")) & (F.max("kinds") <= 1)).alias("even")
    )
    ordered = F.transform("parts", lambda p: p["n"]) == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p["content"]))
    content = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["content"]))
    total = F.element_at("parts", -1)["total"]
    good = F.col("even") & ordered & F.forall("parts", lambda p: p["complete"]) & F.coalesce(total == length, F.lit(False))
    lead = F.element_at("parts", 1)
    whole_again = joined.select(F.col("origin").alias("record_id"), lead["warc_type"].alias("warc_type"), lead["headers"].alias("headers"), content.alias("content"), good.alias("complete"), "copies")
    return whole.unionByName(whole_again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies"))


def payloads(records: DataFrame) -> DataFrame:
    """(record_id, warc_type, refers_to, stated_sha1, payload, valid) of reassembled records.

    The HTTP head is taken off and the chunked framing decoded. ``valid`` means complete, well framed, and of the stated
    SHA-1; a revisit has no payload of its own and is valid if complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[], [], [], [], [], []]
                for rid, kind, headers, content, complete in zip(*(part.column(c).to_pylist() for c in ("record_id", "warc_type", "headers", "content", "complete")), strict=True):
                    headers = dict(headers or [])
                    sha1 = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    head, _, body = content.partition(b"\r\n\r\n")
                    payload = None
                    if kind != "revisit":
                        payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
                    valid = bool(complete) and (kind == "revisit" or (payload is not None and (sha1 is None or hashlib.sha1(payload).hexdigest() == sha1)))
                    for column, value in zip(out, (rid, kind, headers.get("warc-refers-to"), sha1, payload, valid), strict=True):
                        column.append(value)
                types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["record_id", "warc_type", "refers_to", "stated_sha1", "payload", "valid"])

    schema = "record_id string, warc_type string, refers_to string, stated_sha1 string, payload binary, valid boolean"
    return records.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_revisit: int = 1000, segment: int = SEGMENT, gzip: bool = True) -> DataFrame:
    """Write ``pages`` as archives, read them back (`pages_of`)."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit, segment, gzip)
    return pages_of(pages.sparkSession, path, min_revisit, gzip)


def pages_of(spark: SparkSession, path: str, min_revisit: int = 1000, gzip: bool = True) -> DataFrame:
    """The pages in archives of `write_archives`: page_id, payload_bytes, payload_digest, record_type, refers_to, valid.

    A null html is an empty payload, an empty one too; neither is a revisit. A null url is an empty header. A null
    page_id comes back null. Lengths and digests are those of what was read: both are null, and ``valid`` is false, for a
    response whose payload can't be read and for a revisit whose response isn't there with the digest that it states.
    """
    read = payloads(reassemble(read_archives(spark, path, gzip)))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    rows = read.select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
        "valid",
        "stated_sha1",
    )
    rows = stage(rows, "records")
    # a revisit has the payload of the response that it refers to, whose digest must be the one that it states
    responses = rows.where("record_type = 'response' and payload_bytes >= %d and valid" % min_revisit).select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("its_digest"), F.col("payload_bytes").alias("its_bytes")
    ).dropDuplicates(["refers_to", "its_digest"])
    revisits = rows.where("record_type = 'revisit'").join(responses.withColumn("stated_sha1", F.col("its_digest")).hint("merge"), ["refers_to", "stated_sha1"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    revisits = revisits.select("page_id", F.col("its_bytes").alias("payload_bytes"), F.col("its_digest").alias("payload_digest"), "record_type", "refers_to", (F.col("valid") & F.col("its_bytes").isNotNull()).alias("valid"))
    return rows.where("record_type is null or record_type <> 'revisit'").select(*columns).unionByName(revisits)

"""WARC archives with segmented records: writing, reading back and reassembly.

Payloads are written as HTTP responses in chunked transfer framing; a record block longer than SEGMENT bytes is
written as a first record and continuation records that name its identifier as their origin. Records with an
equal payload are written once, later ones as revisits. Archives are read by their records' lengths; segments
are grouped by origin, put in order, checked against the total length, and the transfer framing is decoded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.store import saved, ship

SEGMENT = 64 << 10
CHUNK = 16 << 10
RECORDS_PER_FILE = 1024
LEAST_REVISIT = 100
#: Digests (of about 100 bytes a row) up to this number are broadcast.
BROADCAST_DIGESTS = 200_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace of URLs
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def plan(pages: DataFrame, text: str = "html", key: str = "page_id", least: int = LEAST_REVISIT) -> DataFrame:
    """(row, page_id, url, payload, payload_bytes, payload_digest, refers_to, refers_row) of pages(page_id, url, html).

    row names the row where it is read, so pages must give the same rows in the same tasks when read again, as a table
    does; records are named after it. refers_to is the least page_id with an equal payload of at least `least` bytes, if that is another one. Equal
    payloads are counted by digest before anything is joined, so a payload with very many rows makes one row.
    """
    payload = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    twice = (
        base.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("f"))
        .where("n > 1 AND f IS NOT NULL")
        .select("payload_digest", F.col("f.page_id").alias("first"), F.col("f.row").alias("first_row"))
    )
    # Payloads stay where they are read while the digests that occur twice are few; else both sides are shuffled.
    twice = saved(twice, "warc-twice")
    few = twice.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    joined = base.join(F.broadcast(twice) if few else twice.hint("merge"), "payload_digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    out = joined.withColumn("refers_to", refers)
    return out.select("row", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", F.when(F.col("refers_to").isNotNull(), F.col("first_row")).alias("refers_row"))


def _char_cut(data: bytes, at: int) -> int:
    """The greatest place up to `at` that does not part a character."""
    while at > 0 and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _cut(data: bytes, size: int) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        end = _char_cut(data, min(at + size, len(data)))
        end = end if end > at else min(at + size, len(data))
        out.append(data[at:end])
        at = end
    return out or [b""]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in _cut(payload, size) if c]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": len(block)}.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _ident(row: int, page_id: int | None) -> str:
    """The identifier of a row's record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{row}/{page_id}')}>"


def _records(row: int, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_row: int | None) -> list[bytes]:
    ident = _ident(row, page_id)
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common: dict[str, object] = {"WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": clean, "X-Page-Id": page_id, "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": size}
    if refers_to is not None:
        more = {"WARC-Record-ID": ident, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _ident(refers_row, refers_to), "X-Refers-To-Page": refers_to, "Content-Type": "application/http;msgtype=response"}
        return [_record("revisit", common | more, b"HTTP/1.1 200 OK\r\n\r\n")]
    parts = _cut(_HTTP + chunked(payload), SEGMENT)
    first = common | {"WARC-Record-ID": ident, "Content-Type": "application/http;msgtype=response", "WARC-Segment-Number": 1 if len(parts) > 1 else None}
    out = [_record("response", first, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = sum(map(len, parts)) if k == len(parts) else None
        ident_k = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{row}/{page_id}/{k}')}>"
        out.append(_record("continuation", {"WARC-Record-ID": ident_k, "WARC-Date": common["WARC-Date"], "WARC-Segment-Origin-ID": ident, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": total}, part))
    return out


def write_archives(planned: DataFrame, path: str) -> None:
    """Write the records of plan() as gzip archives of at most RECORDS_PER_FILE records each, through Spark's writer.

    The text writer puts records one after the other with the two empty lines that end a record. Segments keep
    archives of bounded size and may stand in any of them. Characters are never parted between segments, as the
    writer takes text.
    """
    ship(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in _records(*row):
                    out.append(r)
                    held += len(r)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    text = planned.mapInArrow(run, "value string")
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def members(data: bytes) -> Iterator[bytes]:
    """An archive's bytes, of all gzip members one after the other; what is no gzip is given as it is.

    Archives usually hold one member a record. Each is inflated by itself."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out = one.decompress(data) + one.flush()
        if not one.eof:
            raise ValueError("the archive ends inside a gzip member")
        yield out
        data = one.unused_data
    if data.strip(b"\0"):
        raise ValueError("bytes after the last gzip member")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, by their lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError("the archive ends inside a record's header")
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, size = end + 4, int(head["content-length"])
        if begin + size > len(data):
            raise ValueError("the archive ends inside a record's block")
        yield head, data[begin : begin + size]
        at = begin + size
        while data[at : at + 2] == b"\r\n":
            at += 2


_RECORDS = "ident string, origin string, segment int, total long, kind string, page_id long, payload_bytes long, digest string, refers_to long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of all archives under path, whichever file it stands in."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ident", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column(0):
                # Records may go over the ends of members.
                data = b"".join(members(content.as_py()))
                rows, held = [], 0
                for h, block in parse(data):
                    ident = h.get("warc-record-id")
                    rows.append((ident, h.get("warc-segment-origin-id", ident), number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), h.get("warc-type"), number(h, "x-page-id"), number(h, "x-payload-length"), (h.get("warc-payload-digest") or "").rpartition(":")[2] or None, number(h, "x-refers-to-page"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """(page_id, record_type, payload, payload_bytes, payload_digest, refers_to): one row for each whole record.

    Records without segment numbers are whole and stay where they are. The others are grouped by origin and put
    in order of their numbers; numbers must run from 1 without a gap and the blocks add up to the total length
    that the last one gives, else the job fails. payload is null for revisits. For responses length and digest
    are taken from the decoded payload, and must agree with the record's.
    """
    ship(records.sparkSession)
    parts = records.where("segment IS NOT NULL")
    grouped = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "payload_bytes", "digest", "refers_to")],
    )
    block = F.aggregate("s.block", F.lit(b""), lambda a, b: F.concat(a, b))
    right = (F.transform("s.segment", lambda x: x) == F.sequence(F.lit(1), F.size("s"))) & F.col("total").isNotNull()
    joined = grouped.withColumn("block", block).withColumn("block", F.when(right & (F.octet_length("block") == F.col("total")), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing or of wrong length: "), F.col("origin")))))
    cols = ["kind", "page_id", "payload_bytes", "digest", "refers_to", "block"]
    whole = records.where("segment IS NULL").select(*cols).unionByName(joined.select(*cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payloads, sizes, digests = [], [], []
                for kind, size, digest, block in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("kind", "payload_bytes", "digest", "block")), strict=True):
                    if kind == "revisit":
                        payloads.append(None)
                        sizes.append(size)
                        digests.append(digest)
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    own = hashlib.sha256(payload).hexdigest()
                    if size not in (None, len(payload)) or digest not in (None, own):
                        raise ValueError("a payload does not agree with its record")
                    payloads.append(payload)
                    sizes.append(len(payload))
                    digests.append(own)
                get = lambda c: part.column(part.schema.get_field_index(c))
                yield pa.RecordBatch.from_arrays(
                    [get("page_id"), get("kind"), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), get("refers_to")],
                    names=["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"],
                )

    return whole.mapInArrow(run, "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write pages(page_id, url, html) to archives under path and read them back.

    One row for each row of pages. Null html is an empty payload. Of rows with equal payloads of at least 100
    bytes those with the least page_id are responses (all of them, if that row is repeated), the others revisits;
    shorter payloads are always responses. A null page_id is carried and revisits the least id that is not null.
    An empty table gives an empty result; a very long payload is written in segments.
    """
    write_archives(plan(pages), path)
    return reassemble(read_records(pages.sparkSession, path))


def digest_of(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, null as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)

"""WARC archives with segmented records: written by Spark's own writer, read back, and put together again.

A response whose block exceeds `segment` bytes is cut: the first record holds segment 1, continuation records name it as
their origin. Reading groups the parts by origin, orders them by number, verifies numbers and total length, and
undoes the chunked transfer framing. Defined cases: a null payload is empty; of rows of equal payload (100 bytes or more) all
with the smallest page_id are responses, the rest revisit it; a null page_id is never referred to: its row is a revisit if
another has the payload, else a response; damaged records get a status other than "ok" and no payload; an archive
that ends early or holds something else gives its sound records, then one row of kind "damaged" with the reason in `refers`.
Archives may be gzip files of any number of members (one for each record is usual) or plain ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, text_of

#: Payloads below this are never deduplicated.
LEAST_REVISIT = 100
END = b"\r\n\r\n"


def chunked(body: bytes, size: int = 4096) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for i in range(0, len(body), size) if (c := body[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are allowed. Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        eol = framed.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("no chunk size")
        size = int(framed[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the final line feed, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + END[:3]


def name_of(page: int, digest: str) -> str:
    """What revisits call the response of a page with this payload."""
    return f"<urn:phasegrid:page:{page}:{digest}>"


def records_of(row: dict, segment: int) -> Iterator[bytes]:
    rid = f"<urn:phasegrid:{row['_row']:x}>"
    body = row["_html"]
    digest = f"sha256:{row['_digest']}"
    page = row["_page"]
    uri = " ".join((row["_url"] or "about:blank").split())
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("Phasegrid-Page-Id", page)]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    http = ("Content-Type", "application/http; msgtype=response")
    if row["_first"] is not None and page != row["_first"]:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, profile, ("WARC-Refers-To", name_of(row["_first"], digest)), http], status)
        return
    block = status + chunked(body)
    cuts = list(range(0, len(block), segment)) if len(block) > segment else [0]
    for k, at in enumerate(cuts, 1):
        many = len(cuts) > 1
        own = [("WARC-Segment-Number", k)] if many else []
        if k == len(cuts) and many:
            own.append(("WARC-Segment-Total-Length", len(block)))
        if k == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, *own, http], block[at : at + segment] if many else block)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", rid), *own], block[at : at + segment])


def write_archives(pages: DataFrame, path: str, segment: int = 8192, per_file: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one response or revisit for each row. Files hold per_file records at most, and so bounded bytes."""
    body = text_of(html)
    salt = F.pmod(F.xxhash64(page_id, url), F.lit(32)).cast("int").alias("_salt")
    rows = pages.select(F.col(page_id).cast("long").alias("_page"), F.col(url).cast("string").alias("_url"), body.alias("_body"), F.sha2(body, 256).alias("_digest"), salt)
    # Copies of one payload are dealt over salts, so that a payload of a third of all rows is no single task's work.
    parts = rows.where(F.octet_length("_body") >= LEAST_REVISIT).groupBy("_digest", "_salt").agg(F.min("_page").alias("_first"), F.count("*").alias("_n"))
    firsts = parts.groupBy("_digest").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"), F.collect_set("_salt").alias("_salts")).where("_n > 1").select("_digest", "_first", F.explode("_salts").alias("_salt"))
    joined = rows.join(firsts, ["_digest", "_salt"], "left").select("_page", "_url", F.col("_body").cast("binary").alias("_html"), "_digest", F.monotonically_increasing_id().alias("_row"), "_first")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                for r in records_of(batch.slice(i, 1).to_pylist()[0], segment):
                    out.append(r)
                    held += len(r)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    laid = joined.mapInArrow(lay_out, "value binary")
    laid.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class Damaged(ValueError):
    """What is wrong with an archive."""


def inflated(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of all gzip members one after another, or of a plain file, in pieces; raises Damaged where a member is broken or ends early."""
    if not content.startswith(b"\x1f\x8b"):
        yield content
        return
    rest = content
    while rest.strip(b"\0"):
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                out = member.decompress(rest, piece)
                rest = member.unconsumed_tail or member.unused_data
                if out:
                    yield out
                elif not member.eof:
                    raise Damaged("a gzip member ends early")
        except zlib.error as e:
            raise Damaged(f"a gzip member is broken: {e}") from e


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record; raises Damaged where the archive is broken. Holds one record at a time."""
    held, at, source = bytearray(), 0, iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while len(held) - at < 7 and more():
            pass
        if len(held) == at:
            return
        if not held.startswith(b"WARC/1.", at):
            raise Damaged("something other than a record")
        seen = at
        while (eoh := held.find(END, seen)) < 0:
            seen = max(at, len(held) - 3)
            if not more():
                raise Damaged("a header ends early")
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in held[at:eoh].decode("utf-8", "replace").split("\r\n")[1:]))
        size = head.get("content-length", "")
        if not size.isdigit() or not {"warc-type", "warc-record-id"} <= set(head):
            raise Damaged("a header lacks its type, id or length")
        start, end = eoh + 4, eoh + 4 + int(size)
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != END:
            raise Damaged("a record ends early")
        yield head, bytes(held[start:end])
        at = end + 4
        if at > 1 << 20:
            del held[:at]
            at = 0


RECORDS = "record_id string, kind string, page_id long, url string, digest string, refers string, origin string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

        def number(x: str | None) -> int | None:
            return int(x) if x is not None and x.isdigit() else None

        def rows_of(path: str, content: bytes) -> Iterator[tuple]:
            try:
                for h, block in parse(inflated(content)):
                    yield (h["warc-record-id"], h["warc-type"], number(h.get("phasegrid-page-id")), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), h.get("warc-segment-origin-id"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), block)
            except Damaged as e:
                yield (path, "damaged", None, None, None, str(e), None, None, None, None)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row in rows_of(path.as_py(), content.as_py()):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # Small batches: each row is a whole file.
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("path", "content").mapInArrow(read, RECORDS)


JOINED = "record_id string, kind string, page_id long, url string, digest string, refers string, block binary, status string"


def joined_segments(records: DataFrame) -> DataFrame:
    """One row for each response or revisit, its block whole again; status says what is wrong, if anything.

    The parts of a record come in order of their numbers to one pass that checks and joins them, so the time is in proportion
    to the bytes, and a task holds one record at a time.
    """
    own = [x.split()[0] for x in JOINED.split(", ")][:-2]
    whole = records.where("segment is null").select(*own, "block", F.when(F.col("kind") == "damaged", "damaged archive").when(F.col("kind") == "continuation", "segments missing").otherwise("ok").alias("status"))
    parts = records.where("segment is not null").select(F.coalesce("origin", "record_id").alias("_of"), "*")
    return whole.unionByName(parts.repartition("_of").sortWithinPartitions("_of", "segment").mapInArrow(_end_to_end, JOINED))


def _end_to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records whose parts come one after another; portions of about 4 MB go out."""
    out: list[tuple] = []
    held, now, parts = 0, None, []
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)], names=[x.split()[0] for x in JOINED.split(", ")])

    def whole() -> tuple:
        first = next((p for p in parts if p["origin"] is None), {})
        block = b"".join(p["block"] or b"" for p in parts)
        total = next((p["total"] for p in parts if p["total"] is not None), None)
        state = "ok"
        if not first or [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
            state = "segments missing"
        elif total != len(block):
            state = "wrong length"
        return (now, *(first.get(x) for x in ("kind", "page_id", "url", "digest", "refers")), block, state)

    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1).to_pylist()[0]
            if part["_of"] != now and parts:
                out.append(whole())
                held += len(out[-1][6])
                parts = []
                if held > 4 << 20:
                    yield give()
                    out, held = [], 0
            now = part["_of"]
            parts.append(part)
    if parts:
        out.append(whole())
    yield give()


PAYLOADS = "record_id string, kind string, page_id long, url string, digest string, refers string, status string, payload binary"


def payloads(joined: DataFrame) -> DataFrame:
    """The payload of each response, freed of HTTP headers and framing and held against its digest."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, states = [], []
            for kind, digest, state, block in zip(*(batch.column(c).to_pylist() for c in ("kind", "digest", "status", "block"))):
                body = None
                if state == "ok" and kind == "response":
                    head, _, rest = (block or b"").partition(END)
                    try:
                        body = unchunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest
                        if digest and digest.removeprefix("sha256:") != hashlib.sha256(body).hexdigest():
                            body, state = None, "wrong digest"
                    except ValueError:
                        state = "broken framing"
                out.append(body)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("record_id", "kind", "page_id", "url", "digest", "refers")), pa.array(states, pa.string()), pa.array(out, pa.binary())], names=[x.split()[0] for x in PAYLOADS.split(", ")])

    return joined.mapInArrow(decode, PAYLOADS)


def round_trip(pages: DataFrame, segment: int = 8192, **names: str) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, status)."""
    path = scratch(pages.sparkSession, "archives")
    write_archives(pages, path, segment, **names)
    back = payloads(joined_segments(read_records(pages.sparkSession, path)))
    back = back.select("record_id", "kind", "page_id", "refers", "status", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"))
    back = cut(back)
    name = F.concat(F.lit("<urn:phasegrid:page:"), F.col("page_id"), F.lit(":sha256:"), F.col("sha"), F.lit(">"))
    first = back.where("kind = 'response'").groupBy(name.alias("refers"), "page_id", "n", "sha").agg(F.count("*").alias("_c")).select("refers", F.col("page_id").alias("refers_to"), F.col("n").alias("_n"), F.col("sha").alias("_sha"), F.lit(True).alias("_to"))
    # Revisits of one page are dealt over salts.
    again = back.where("kind = 'revisit'").withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(32)).cast("int"))
    used = again.select("refers", "_salt").distinct()
    again = again.join(first.join(used, "refers"), ["refers", "_salt"], "left")
    own = back.where("kind = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "status")
    return own.unionByName(again.select("page_id", F.col("_n").alias("payload_bytes"), F.col("_sha").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", F.when(F.col("_to").isNull(), "nothing to refer to").otherwise(F.col("status")).alias("status")))

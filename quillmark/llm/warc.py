"""WARC transactions: written as request, response or revisit, and metadata records, read back and
assembled by their concurrent-to identifiers into one nested row a capture.

Records are made with SQL functions and written by Spark's text sink, whose line separator is the
blank line pair that ends a record, so any file system that Spark writes to will do.  A file is
compressed as a whole and holds at most ``PER_FILE`` captures, or as many as make up ``FILE_BYTES`` at
the mean size if these are fewer; captures beyond the first of ``SIZES`` are written apart, as many to a file as
their class's largest allows.  A file is read as a stream, a record at a time.  Payloads of 1000
bytes or more are kept once: of equal ones that of the largest page_id is the response and the
others revisit it.

Every row is a capture of its own.  Record ids come from page_id, payload digest and a number among
the rows that share both, so they are the same in every attempt; those rows are numbered in one task.

Defined cases: a null html is an empty payload; a null url is written as an empty target and read
back as null; rows with a null page_id are archived under the empty id, read back as null and are
never revisits; of rows with the largest page_id of a digest each is a response; payloads may hold
any text, blank lines and WARC headers included, since reading goes by Content-Length; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import settle, shared_dir, table

MIN_REVISIT = 1000
PER_FILE = 2000
FILE_BYTES = 32 << 20
#: Captures are written apart by size, up to each of these, so that a run of large ones makes no large file.
SIZES = (64 << 10, 1 << 20, 16 << 20, 1 << 31)
#: Bits of the bitmap of shared digests; a full one is 8 MB of rows.
DIGEST_BITS = 25
EOL = "\r\n"
_UUID = "urn:uuid:"


def _uuid(kind: str, own: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), own).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<" + _UUID), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column]], body: Column) -> Column:
    """A record without its closing blank lines, which the sink adds."""
    head = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{k}: "), v) for k, v in fields] + [F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(EOL, *head), F.lit(EOL + EOL), body)


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, copy (1, 2, ... among the rows of one
    page_id and digest, by url), record_type, refers_to.

    Digests that several rows share are found from digests alone, and a bitmap of them, of a bounded
    size, is broadcast.  Rows whose digest isn't in it stand alone and never move; the others go by
    digest and id, so a hot digest is many keys: the largest page_id of a digest comes from a
    pre-aggregated table, and numbering needs no other shuffle."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("bigint")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("own", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    ids = settle(rows.groupBy("payload_digest", "own").agg(F.max("page_id").alias("id"), F.max("payload_bytes").alias("bytes"), F.count("*").alias("rows")))
    shared = ids.groupBy("payload_digest").agg(F.max("id").alias("first"), F.sum("rows").alias("n"), F.max("bytes").alias("bytes")).where("n > 1")
    place = F.shiftright(F.conv(F.substring("payload_digest", 1, 8), 16, 10).cast("bigint"), 32 - DIGEST_BITS)
    word, bit = F.shiftright(place, 6).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    bitmap = shared.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))  # 2**(DIGEST_BITS - 6) rows at most
    marked = rows.withColumn("word", word).join(F.broadcast(bitmap), "word", "left")
    is_shared = F.coalesce(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(False))
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    alone = marked.where(~is_shared).select(*names, F.lit(1).alias("copy"), F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    first = shared.where(F.col("bytes") >= MIN_REVISIT).select("payload_digest", "first")
    again = ids.where("id is not null").join(first, "payload_digest").where("id <> first").select("payload_digest", "own", F.col("first").alias("refers_to"))
    equal = Window.partitionBy("payload_digest", "own").orderBy("url")
    out = marked.where(is_shared).join(again, ["payload_digest", "own"], "left").withColumn("copy", F.row_number().over(equal))
    return alone.unionByName(out.select(*names, "copy", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive each page as request, response (or revisit) and metadata records."""
    d = decide(pages)
    own, url = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    capture = lambda page, copy: F.concat_ws(":", page, "payload_digest", copy)
    this = capture(own, F.col("copy").cast("string"))
    revisit = F.col("record_type") == "revisit"
    host = F.coalesce(F.parse_url(F.regexp_replace(url, r"[\s\[\]{}|\\^`<>\"]", "_"), F.lit("HOST")), F.lit(""))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    http = F.concat(F.lit(EOL.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    response = _record(
        [
            ("WARC-Type", F.col("record_type")),
            ("WARC-Record-ID", _uuid("response", this)),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Refers-To", F.when(revisit, _uuid("response", capture(F.col("refers_to").cast("string"), F.lit("1"))))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", this)), *common, ("WARC-Concurrent-To", _uuid("response", this)), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + EOL + "Host: "), host, F.lit(EOL + EOL)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", this)), *common, ("WARC-Concurrent-To", _uuid("response", this)), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), own, F.lit(EOL)),
    )
    size = F.octet_length(F.col("html").cast("string"))
    light = F.coalesce(size, F.lit(0)) <= SIZES[0]
    mean, most = pages.agg(F.avg(F.when(light, F.coalesce(size, F.lit(0)))), F.max(size)).first()
    low = -1
    for high in SIZES:
        # small captures by their mean, as so many of the largest make no large file; others by their class's largest
        each = max(1, min(PER_FILE, int(FILE_BYTES / ((mean or 0) + 1000 if low < 0 else high))))
        own = d.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        records = own.select(F.explode(F.array(request, response, metadata)).alias("value"))
        records.write.mode("append").option("lineSep", EOL + EOL).option("maxRecordsPerFile", 3 * each).option("compression", "gzip").text(path)
        low = high
        if (most or 0) <= high:
            break


_HEAD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of gzip members, a bounded chunk at a time."""
    while data:
        z = zlib.decompressobj(31)
        while not z.eof:
            chunk = z.decompress(data, step)
            data = z.unconsumed_tail
            if chunk:
                yield chunk
            elif not data and not z.eof:
                raise ValueError("the archive is cut off")
        data = z.unused_data


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives: type, id, concurrent_to, refers_to, uri, digest, payload (the HTTP
    body of responses), payload_sha1, fields (of metadata records)."""
    schema = "type string, id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes bigint, payload_sha1 string, payload binary, fields map<string,string>"

    def records(data: bytes) -> Iterator[tuple]:
        chunks, held, at = _inflate(data), b"", 0
        while True:
            while (stop := held.find(b"\r\n\r\n", at)) < 0:
                chunk = next(chunks, None)
                if chunk is None:
                    return
                held, at = held[at:] + chunk, 0
            head = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEAD.findall(held, held.find(b"\n", at) + 1, stop + 2)}
            start, size = stop + 4, int(head["content-length"])
            if len(held) < start + size + 4:
                more, have = [held[at:]], len(held)
                while have < start + size + 4 and (chunk := next(chunks, None)) is not None:
                    more.append(chunk)
                    have += len(chunk)
                held, start, at = b"".join(more), start - at, 0
            body, kind = held[start : start + size], head["warc-type"]
            if len(body) < size:
                raise ValueError(f"record {head.get('warc-record-id')} is cut off")
            at = start + size + 4
            payload = fields = None
            if kind in ("response", "revisit"):
                payload = body[body.find(b"\r\n\r\n") + 4 :]
            elif kind == "metadata":
                fields = [(k.decode(), v.decode("utf-8", "replace")) for k, v in _HEAD.findall(body)]
            sha = hashlib.sha1(payload).hexdigest() if kind == "response" else None
            yield kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri") or None, head.get("warc-payload-digest"), None if payload is None else len(payload), sha, payload, fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]
        names = ["type", "id", "concurrent_to", "refers_to", "uri", "digest", "payload_bytes", "payload_sha1", "payload", "fields"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for r in records(batch.column(0)[k].as_py()):
                    rows.append(r)
                    size += len(r[8] or b"")
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: id, request, response and metadata structs.

    Requests and metadata name the response they are concurrent to; all meet by that id."""
    capture = F.coalesce("concurrent_to", "id").alias("capture")
    light = records.select(capture, "type", "id", "uri", "fields", "digest", "payload_bytes", "payload_sha1", "refers_to")
    of = lambda kinds, *cols: F.first(F.when(F.col("type").isin(*kinds), F.struct(*cols)), ignorenulls=True)
    return light.groupBy("capture").agg(
        of(("request",), "id", "uri").alias("request"),
        of(("response", "revisit"), "id", "type", "uri", "digest", "payload_bytes", "payload_sha1", "refers_to").alias("response"),
        of(("metadata",), "id", "fields").alias("metadata"),
    )


def captures(assembled: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture.

    Size and digest of a response are those of the payload read; a revisit has those of the response
    that its WARC-Refers-To names, and that one's page_id."""
    own = settle(
        assembled.select(
            "capture",
            F.expr("try_cast(metadata.fields['page-id'] as bigint)").alias("page_id"),
            F.col("response.type").alias("record_type"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_sha1").alias("payload_digest"),
            F.col("response.refers_to").alias("target"),
        )
    )
    responses, revisits = own.where("record_type = 'response'"), own.where("record_type = 'revisit'")
    named = responses.select(F.col("capture").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    followed = revisits.select("page_id", "record_type", "target").join(named, "target", "left")
    whole = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return whole.unionByName(followed.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything returned is read from the archives."""
    path = shared_dir(spark) + "/archive"
    write(table(spark, sf_dir, "pages"), path)
    return captures(assemble(read(spark, path)))


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN b >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN b >= 1000 AND page_id <> m THEN m END AS refers_to FROM m
"""

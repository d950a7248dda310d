"""WARC archives: pages written as request, response or revisit, and metadata records; archives read back and assembled into captures.

Spark's own writers and readers carry the files, so they land where any Spark store is and commit as Spark jobs do. An archive is bounded in
size, and a task holds one at a time. Records of a capture need not lie together: they are joined by what WARC-Concurrent-To names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import written
from quillon.llm.components import spread_join

#: Payload bytes of an archive, about; one page that is longer makes a longer one.
ARCHIVE_BYTES = 16 << 20
CRLF = "\r\n"
#: Digests with more than this share of all rows are few, and looked up without a shuffle.
HOT_GROUPS = 1000
#: Fixed values of the format.
VERSION, ALPHABET = "WARC/1.1", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, declared string, http string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string"


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a digest of 40 hexadecimal digits: five of them, 20 bits, give four letters."""
    letter = lambda x, shift: F.substring(F.lit(ALPHABET), F.shiftright(x, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(sha1, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.array_join(F.transform(bits, lambda x: F.concat(*(letter(x, s) for s in (15, 10, 5, 0)))), "")


def record_id(*parts: Column | str) -> Column:
    """A name in the form of a UUID from the parts' digest; nulls have a spelling of their own."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in (F.lit(x) if isinstance(x, str) else x for x in parts))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def escaped(uri: Column) -> Column:
    """A uri that fits in a header line: white space and control characters in percent form; null is about:blank."""
    out = uri
    for code in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(F.when(uri.rlike(r"[\x00-\x20\x7F]"), out).otherwise(uri), F.lit("about:blank"))


def record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """A whole record but for its last line end, which the text writer adds."""
    lines = [F.lit(VERSION)]
    for name, value in headers:
        if value is not None:
            lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block, F.lit(CRLF))


def http_head(uri: Column, start: Column | str, more: list[Column | str]) -> Column:
    return F.concat_ws(CRLF, *(F.lit(x) if isinstance(x, str) else x for x in (start, *more)), F.lit(CRLF))


def judged(rows: DataFrame, revisit_bytes: int) -> DataFrame:
    """Rows (w_id, w_url, w_body, w_bytes, w_digest) with copy, a number among rows that repeat all of them, and first, the id and url of the response that a row revisits, null for a response."""
    same = ["w_digest", "w_id", "w_url"]
    place = F.struct(F.col("w_id").isNull().alias("no_id"), F.col("w_id").alias("id"), F.col("w_url").isNull().alias("no_url"), F.col("w_url").alias("url"))
    each = rows.groupBy(*same).agg(F.count("*").alias("copies"))
    groups = written(each.groupBy("w_digest").agg(F.sum("copies").alias("n"), F.max("copies").alias("most"), F.min(place).alias("head")).where(F.col("n") > 1), "warc-groups")
    total = rows.select("w_digest").count()
    hot = F.col("n") > F.lit(max(1000, total // HOT_GROUPS))  # at most HOT_GROUPS of these
    names = groups.columns
    near = rows.join(F.broadcast(groups.where(hot)), "w_digest", "left")
    far = near.where(F.col("n").isNull()).drop(*names[1:]).join(groups.where(~hot), "w_digest", "left")
    all_ = near.where(F.col("n").isNotNull()).unionByName(far)
    keeps = F.col("head").isNull() | (F.col("w_bytes") < revisit_bytes) | (place == F.col("head"))
    all_ = all_.withColumn("w_body", F.when(keeps, F.col("w_body")))
    single = all_.where(F.coalesce(F.col("most"), F.lit(1)) == 1).withColumn("copy", F.lit(1))
    repeated = all_.where(F.col("most") > 1).groupBy(*same).agg(*(F.first(c).alias(c) for c in ("w_body", "w_bytes", "head", "n", "most")), F.count("*").alias("copies"))
    repeated = repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    response = F.col("head").isNull() | (F.col("w_bytes") < revisit_bytes) | ((place == F.col("head")) & (F.col("copy") == 1))
    return single.unionByName(repeated).withColumn("first", F.when(~response, F.col("head"))).drop("head", "n", "most")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes three records a page as WARC files under ``path``: response or revisit, request, and metadata (the page's id), which name it.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes the first by page id (null last), then by url, is the response; the
    others revisit it and carry no payload. Of rows that repeat id, url and payload one is the response. A null payload is empty, a null url
    about:blank. Record names depend on the rows alone. Other columns are not read. An empty table writes no record. Only digests that
    repeat are joined with the pages, the at most ``HOT_GROUPS`` most frequent ones by broadcast.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("w_id"), F.col(f"`{url}`").cast("string").alias("w_url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("w_body"))
    rows = rows.withColumn("w_digest", F.sha1(F.col("w_body").cast("binary"))).withColumn("w_bytes", F.octet_length("w_body"))
    size = rows.agg(F.coalesce(F.avg("w_bytes"), F.lit(0.0))).first()[0]
    c = F.col
    uri, sha, main, asked = c("w_uri"), c("w_sha"), c("w_main"), c("w_asked")
    own = lambda kind: record_id(kind, c("w_id"), c("w_url"), c("w_digest"), c("copy"))
    named = {"w_uri": escaped(c("w_url")), "w_sha": F.concat(F.lit("sha1:"), base32(c("w_digest"))), "w_main": own("capture"), "w_asked": own("request")}
    head_of = record_id("capture", c("first.id"), c("first.url"), c("w_digest"), F.lit(1))
    status = http_head(uri, "HTTP/1.1 200 OK", ["Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), c("w_bytes").cast("string"))])
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    response = record([("WARC-Type", "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", sha), ("Content-Type", "application/http; msgtype=response")], F.concat(status, c("w_body")))
    revisit = record([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", head_of), ("WARC-Payload-Digest", sha), ("Content-Type", "application/http; msgtype=response")], status)
    target = F.coalesce(F.nullif(F.regexp_extract(uri, "^[^:/?#]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", asked), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http; msgtype=request")], http_head(uri, F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1")), [F.concat(F.lit("Host: "), F.regexp_extract(uri, "^[^:/?#]+://([^/?#]*)", 1))]))
    told = F.concat(F.coalesce(F.concat(F.lit("page_id: "), c("w_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("payload_bytes: "), c("w_bytes").cast("string"), F.lit(CRLF))
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", asked), *common, ("Content-Type", "application/warc-fields")], told)
    out = judged(rows, revisit_bytes).withColumns(named).select(F.explode(F.array(F.when(c("first").isNull(), response).otherwise(revisit), request, metadata)).alias("value"))
    most = max(3, 3 * int(ARCHIVE_BYTES / max(size + 1500, 1)))
    out.write.option("lineSep", CRLF).option("maxRecordsPerFile", most).text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """The parts of an archive one at a time: the members of a compressed one, or the whole."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data)
        if not member.eof:
            raise ValueError("a compressed archive is cut off")
        data = member.unused_data


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], memoryview]]:
    """(headers, block) of each record. Lengths decide where a block ends, so a block may hold anything."""
    at, view = 0, memoryview(data)
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        lines = bytes(view[at : max(at, end)]).decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        size = int(dict(headers)["content-length"])
        if end + 4 + size > len(data):
            raise ValueError("a record is cut off")
        yield headers, view[end + 4 : end + 4 + size]
        at = end + 4 + size


def fields_of(block: bytes) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if s]


def row_of(headers: list[tuple[str, str]], block: memoryview) -> tuple:
    """A row of ``RECORDS``. The payload's size and digest are those of the bytes that are there, whatever the headers say; a revisit has none."""
    one = dict(headers)
    kind, content = one.get("warc-type", ""), one.get("content-type", "")
    http, payload = None, None
    if content.startswith("application/http"):
        raw = bytes(block)
        head, _, rest = raw.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        payload = None if kind in ("revisit", "request") else rest
    elif kind in ("response", "resource"):
        payload = bytes(block)
    fields = fields_of(bytes(block)) if content.startswith("application/warc-fields") else []
    digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    declared = one.get("warc-payload-digest")
    near = [v for k, v in headers if k == "warc-concurrent-to"]
    return one.get("warc-record-id"), kind, near, one.get("warc-refers-to"), one.get("warc-target-uri"), one.get("warc-date"), declared and declared.removeprefix("sha1:"), http, fields, payload, None if payload is None else len(payload), digest


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` as rows of ``RECORDS``, compressed ones too. A task holds one archive at a time; one that is cut off raises."""
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string())
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for part in unpacked(batch.column(0)[i].as_py()):
                    for headers, block in records_of(part):
                        rows.append(row_of(headers, block))
                        size += len(block) + 500
                        if size > 4 << 20:
                            yield full(rows)
                            rows, size = [], 0
                if rows:
                    yield full(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, RECORDS)


def assembled(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id, response (struct of a response, revisit or resource record), requests and metadata (arrays of structs).

    A record belongs to the capture of a response that it names as concurrent, that names it, or that a request names which it names or
    which names it; of several, the least by name. The payload is carried where records have it. Requests and metadata records that reach no response are left out, as no capture has them.
    """
    c = F.col
    mains = records.where(c("type").isin("response", "revisit", "resource"))
    others = records.where(c("type").isin("request", "metadata")).select("record_id", "type", "concurrent_to", "target_uri", "date", "http", "fields")
    names = lambda df, key: df.select(key.alias("capture_id"), F.explode(F.concat(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))).alias("alias"))
    known = names(mains, c("record_id"))

    def belong(rows: DataFrame, aliases: DataFrame) -> DataFrame:
        ends = rows.select(c("record_id").alias("own"), F.explode(F.concat(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))).alias("alias"))
        return ends.join(aliases, "alias").groupBy("own").agg(F.min("capture_id").alias("capture_id"))

    requests = others.where(c("type") == "request")
    asked = requests.join(belong(requests, known), c("record_id") == c("own")).drop("own")
    wider = known.unionByName(names(asked, c("capture_id")))
    notes = others.where(c("type") == "metadata")
    noted = notes.join(belong(notes, wider), c("record_id") == c("own")).drop("own")
    shape = lambda df, name, *cols: df.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("record_id", *cols))).alias(name))
    response = mains.select(c("record_id").alias("capture_id"), F.struct("type", "refers_to", "target_uri", "date", "http", "declared", *(["payload"] if "payload" in records.columns else []), "payload_bytes", "payload_digest").alias("response"))
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return response.join(shape(asked, "requests", "target_uri", "date", "http"), "capture_id", "left").join(shape(noted.withColumn("lines", pairs), "metadata", "date", "lines"), "capture_id", "left")


def page_captures(captures: DataFrame, page_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures: of a revisit, size and digest of the response's payload and that page's id.

    The digest is computed from the payload that was read; a revisit of a response that is not there has no size, and its declared digest.
    """
    c = F.col
    line = F.filter(F.get("metadata", F.lit(0))["lines"], lambda x: x.startswith("page_id: "))
    page = F.substring(F.try_element_at(line, F.lit(1)), 10, 100).cast(page_type)
    flat = written(captures.select("capture_id", page.alias("page_id"), c("response.type").alias("record_type"), "response.refers_to", "response.payload_bytes", "response.payload_digest", "response.declared"), "warc-captures")
    again = flat.where(c("record_type") == "revisit")
    heads = flat.join(again.select(c("refers_to").alias("capture_id")).distinct(), "capture_id", "left_semi").select(c("capture_id").alias("refers_to"), c("page_id").alias("head"), c("payload_bytes").alias("bytes"), c("payload_digest").alias("digest"))
    known = spread_join(again, heads, "refers_to", "capture_id").select("page_id", c("bytes").alias("payload_bytes"), c("digest").alias("payload_digest"), "record_type", c("head").alias("refers_to"))
    lost = again.join(heads, "refers_to", "left_anti").select("page_id", "payload_bytes", c("declared").alias("payload_digest"), "record_type", F.lit(None).cast(page_type).alias("refers_to"))
    plain = flat.where(c("record_type") != "revisit").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(page_type).alias("refers_to"))
    return plain.unionByName(known).unionByName(lost)

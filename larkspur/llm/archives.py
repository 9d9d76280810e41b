"""Web archives: legacy ARC files, and a converter that writes WARC.

An ARC file begins with a ``filedesc`` record that names its version; the version
fixes the fields of all header lines (five in version 1, ten in version 2).  The
converter reads header lines and declared lengths, never looking for marks inside
records, and synthesises what WARC needs: record ids, dates, types and digests.
Records whose payload equals that of another become ``revisit`` records.

Files are written by Spark's text writer, whose line separator is the separator of
records; no task writes to a local folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, new_path, parts, small_batches, stage
from ._words import lean

#: Fields of the header lines, by version of the format (fixed values).
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
LEAST_BYTES = 100  # a smaller payload is never a revisit
PAGE = "X-Page-Id"
FILE_BYTES = 32 << 20


def write_arc(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", body: str = "html", date: str = "20240102030405") -> None:
    """Writes the pages as ARC files of both versions, an HTTP response for each page.

    A null body is empty; a null page id gets no header; blanks and controls in a
    URL are escaped, a null or empty URL is ``urn:none``.  Repeated rows give repeated
    records; a table without rows gives no records.
    """
    spark = pages.sparkSession
    total = pages.agg(F.coalesce(F.sum(F.octet_length(F.col(body).cast("string"))), F.lit(0))).first()[0]
    files = max(2, parts(spark), -(-total // FILE_BYTES))  # a reader holds one file
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.coalesce(F.concat(F.lit(PAGE + ": "), F.col(page).cast("string"), F.lit("\r\n")), F.lit("")), F.lit("\r\n"))
    where = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.col(url), "%", "%25"), "[\\x00-\\x20\\x7F]", "%20"), F.lit("")), F.lit("urn:none"))
    # dealt by page and body, so that neither a hot host nor equal bodies meet in one file
    rows = pages.select(F.pmod(F.xxhash64(F.col(page), F.col(body)), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("kind"), where.alias("url"), head.cast("binary").alias("head"), payload.alias("payload"))
    block = F.concat("head", "payload")
    sha = F.sha2("payload", 256)
    line1 = F.concat_ws(" ", "url", F.lit("192.0.2.1"), F.lit(date), F.lit("text/html"), F.octet_length(block).cast("string"))
    name = F.concat(F.lit("legacy-"), F.col("file").cast("string"), F.lit(".arc"))
    line2 = F.concat_ws(" ", "url", F.lit("192.0.2.1"), F.lit(date), F.lit("text/html"), F.lit("200"), sha, F.lit("-"), F.lit("0"), name, F.octet_length(block).cast("string"))
    record = F.concat(F.when(F.col("file") % 2 == 0, line1).otherwise(line2).cast("binary"), F.lit(b"\n"), block)

    def desc(version: int):
        told = f"{version} 0 larkspur\n{' '.join(FIELDS[version])}\n"
        tail = f" 0.0.0.0 {date} text/plain "
        more = f"{len(told)}" if version == 1 else f"200 - - 0 -  {len(told)}".replace("  ", " ")
        return F.concat(F.lit("filedesc://"), name, F.lit(f"{tail}{more}\n{told}")).cast("binary")

    heads = spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(0).alias("kind"))
    heads = heads.withColumn("value", F.when(F.col("file") % 2 == 0, desc(1)).otherwise(desc(2)))
    out = rows.select("file", "kind", record.alias("value")).unionByName(heads)
    # file n is partition n, and its first row is the head
    out = out.repartitionById(files, F.col("file")).sortWithinPartitions("file", "kind")
    out.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _unpacked(content: bytes) -> bytes:
    import zlib

    out, left = [], content
    while left[:2] == b"\x1f\x8b":  # one member after another
        d = zlib.decompressobj(31)
        out.append(d.decompress(left))
        left = d.unused_data
    return b"".join(out) if out else content


def arc_records(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header fields, block) of each record; a filedesc record sets the version for those after it."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        eol = data.index(b"\n", at)
        line = data[at:eol].decode("utf-8").split(" ")
        n = int(line[-1])
        block = data[eol + 1 : eol + 1 + n]
        if len(block) != n:
            raise ValueError(f"a record of {n} bytes ends after {len(block)}")
        if line[0].startswith("filedesc://"):
            told = block.split(b"\n")
            version = int(told[0].split(b" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = tuple(told[1].decode().split(" "))
            if fields != FIELDS[version]:
                raise ValueError(f"fields of ARC version {version}: {fields}")
        elif len(line) != len(fields):
            raise ValueError(f"{len(line)} header fields where {len(fields)} are declared")
        else:
            yield at, dict(zip(fields, line, strict=True)), block
        at = eol + 1 + n


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)


_PAGE = re.compile(rb"\r\n" + PAGE.encode() + rb": (-?[^\r\n]*)\r\n")


def parse_arc(files: DataFrame) -> DataFrame:
    """The records of ARC files, with what WARC needs of each."""
    schema = "page string, url string, ip string, date string, mime string, id string, head binary, payload binary, digest string, bytes long, place string"

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                file = path.as_py().rsplit("/", 1)[-1]
                for at, f, block in arc_records(_unpacked(content.as_py())):
                    head, payload = _split_http(block)
                    page = _PAGE.search(head)
                    digest = hashlib.sha256(payload).hexdigest()
                    day = f["Archive-date"]
                    when = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
                    made = uuid.UUID(bytes=hashlib.sha256(f"{file}\0{at}\0{f['URL']}\0{day}\0{digest}".encode()).digest()[:16], version=5)
                    rows.append((page[1].decode() if page else None, f["URL"], f["IP-address"], when, f["Content-type"], f"<urn:uuid:{made}>", head, payload, digest, len(payload), f"{file}:{at:020d}"))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(lean(run), schema)


def _batch(rows: list, names: list) -> pa.RecordBatch:
    kinds = {"head": pa.binary(), "payload": pa.binary(), "bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.string())) for k, n in enumerate(names)], names=names)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_BYTES) -> None:
    """ARC files to WARC files.  Of equal payloads of at least ``least`` bytes, the one with the smallest page id (a whole number, else null and last) is the response.

    Of repeated records with equal page ids the first in the order of files is the
    response, the others revisit it.  Files without records give WARC files without
    records.  Each file is parsed once.
    """
    with small_batches(spark, 4):
        records = stage(parse_arc(read_bytes(spark, arc_path)), "arc-records", "zstd")
    order = F.struct(F.col("page").try_cast("long").isNull().alias("none"), F.col("page").try_cast("long").alias("page"), F.col("place"))
    told = records.select("digest", "bytes", F.struct(order.alias("o"), "id", "url", "date", "page").alias("first"))
    firsts = told.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("first").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stage(firsts.select("digest", "bytes", F.col("first.id").alias("f_id"), F.col("first.url").alias("f_url"), F.col("first.date").alias("f_date"), F.col("first.page").alias("f_page")), "firsts")
    rows = records.join(firsts, ["digest", "bytes"], "left")
    revisit = F.col("f_id").isNotNull() & (F.col("f_id") != F.col("id"))
    line = lambda name, c: F.concat(F.lit(name + ": "), c, F.lit("\r\n"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", F.col("id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Identified-Payload-Type", F.col("mime")),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            line("WARC-Refers-To", F.col("f_id")), line("WARC-Refers-To-Target-URI", F.col("f_url")), line("WARC-Refers-To-Date", F.col("f_date")),
            F.coalesce(line("X-Refers-To-Page-Id", F.col("f_page")), F.lit("")), line("X-Payload-Length", F.col("bytes").cast("string")),
        )).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)
    drop(firsts, records)


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        f = dict(x.split(": ", 1) for x in lines[1:])
        n = int(f["Content-Length"])
        yield f, data[cut + 4 : cut + 4 + n]
        if data[cut + 4 + n : cut + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is longer than it declares")
        at = cut + 8 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date of each record; digests are computed again and compared.

    Repeated records give repeated rows, files without records none; a record that is
    shorter or longer than it declares is an error.
    """
    schema = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, url string, date string"

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for f, block in warc_records(_unpacked(content.as_py())):
                    head, payload = _split_http(block)
                    page, kind = _PAGE.search(head), f["WARC-Type"]
                    declared = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (got := hashlib.sha256(payload).hexdigest()) != declared:
                        raise ValueError(f"{f['WARC-Record-ID']}: digest {got}, declared {declared}")
                    size = len(payload) if kind == "response" else int(f["X-Payload-Length"])
                    rows.append((page[1].decode() if page else None, size, declared, kind, f.get("X-Refers-To-Page-Id"), f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 1 else pa.string()) for k in range(len(names))], names=names)

    return read_bytes(spark, path).mapInArrow(lean(run), schema)


def through_archives(pages: DataFrame) -> DataFrame:
    """pages to ARC files, to WARC files, and what the WARC files hold: a row for each page, repeated ones too, and none for an empty table."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    drop(arc)
    return read_warc(spark, warc)

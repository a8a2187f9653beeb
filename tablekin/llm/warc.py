"""WARC archives with revisit records for payloads that are there already."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, few_files, forget, new_path, slices, written

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMES = {
    "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Target-URI": "target_uri", "WARC-Date": "date",
    "WARC-Payload-Digest": "digest", "WARC-Refers-To": "refers_to",
}
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID = "urn:page:"


def _header(name: str, value: Column) -> Column:
    """A header line; none for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def resolve_revisits(headers: DataFrame, least: int = 1000) -> DataFrame:
    """headers (id, digest, size, ...) with `original`: the id of the response that a revisit refers to, null for responses.

    Only payloads of `least` bytes and more are resolved. Of equal digests the record with the largest id is the
    response; null ids are smallest. Rows that repeat this id are responses as well. Only one row a digest is joined, so
    a digest with many records can be split.
    """
    big = headers.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("_top"), F.count("*").alias("_n"))
    out = headers.join(big.where("_n > 1").select("digest", "_top"), "digest", "left")
    revisit = (F.col("size") >= least) & F.col("_top").isNotNull() & ~F.col("id").eqNullSafe(F.col("_top"))
    return out.withColumn("original", F.when(revisit, F.col("_top"))).drop("_top")


#: The last byte of a gzip member is the top one of its content's length: 0, but for records of 16 MB and more.
END = b"\0"
EMPTY = gzip.compress(b"", mtime=0)


def _members():
    """Each record as a gzip member without its last byte, which is END; a record of 16 MB gets an empty member besides."""

    def make():
        def one(batch):
            for part in slices(batch, "record"):
                out = []
                for text in part.column("record").to_pylist():
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(text.encode("utf-8", "surrogatepass")) + packer.flush()
                    out.append((member if member.endswith(END) else member + EMPTY)[:-1])
                yield {"member": out}

        return one

    return make


def write_archives(records: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write WARC 1.0 files (`*.warc.gz`) below path from rows (id, uri, payload, digest, original), one record a row.

    Rows with `original` become revisit records without payload; all get fresh headers. Each record is a gzip member of
    its own, so that a reader can start at any of them. Members are written by Spark's text writer, whose line end is a
    member's last byte, and so by its commit protocol; then each file gets its name.
    """
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", name(F.col("id"))),
        _header("WARC-Target-URI", F.col("uri")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, name(F.col("original")))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    members = arrow_map(records.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("record")), _members(), "member binary")
    few_files(members.select(F.col("member").cast("string"))).write.option("lineSep", END.decode()).text(path)
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt")):  # names only; one a file
        if not file.getLen():
            fs.delete(file.getPath(), False)
            continue
        fs.rename(file.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, file.getPath().getName().removesuffix("txt") + "warc.gz"))


class RecordParser:
    """Puts records together from an archive's lines (without their line feeds), by Content-Length alone."""

    def __init__(self):
        self.headers: dict[str, str] = {}
        self.block: list[bytes] | None = None
        self.left = 0

    def add(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """The record (headers, block) that ends with this line, if one does."""
        if self.block is None:
            line = line.rstrip(b"\r")
            if not self.headers:
                if line and not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record begins with {line[:40]!r}")
                self.headers = {"": line.decode()} if line else {}
            elif line:
                name, _, value = line.decode("utf-8").partition(":")
                self.headers[name] = value.strip()
            else:
                self.block, self.left = [], int(self.headers["Content-Length"])
            if self.block is None or self.left:
                return None
        else:
            self.block.append(line + b"\n")
            self.left -= len(line) + 1
        if self.left > 0:
            return None
        block = b"".join(self.block)[: int(self.headers["Content-Length"])]  # the line's rest ends the record
        del self.headers[""]
        out, self.headers, self.block = (self.headers, block), {}, None
        return out


def parse_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open WARC file."""
    parser = RecordParser()
    for line in stream:
        if record := parser.add(line.removesuffix(b"\n")):
            yield record


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of gzipped WARC files: the headers of NAMES, size and sha1 of the payload as it is stored, and, if asked for, the payload.

    Files are read as a stream of lines, so a task holds a record and a batch of lines, however large its archive is.
    """
    fields = [*NAMES.values(), "size", "sha1", *["payload"] * payloads]

    def make():
        parser = RecordParser()

        def one(batch):
            out, held = {c: [] for c in fields}, 0
            for line in batch.column("line").to_pylist():
                if not (record := parser.add(line)):
                    continue
                headers, payload = record[0], record[1].partition(b"\r\n\r\n")[2]
                for h, c in NAMES.items():
                    out[c].append(headers.get(h))
                out["size"].append(len(payload))
                out["sha1"].append(hashlib.sha1(payload).hexdigest())
                if payloads:
                    out["payload"].append(payload.decode("utf-8", "surrogatepass"))
                    held += len(payload)
                if held > 8_000_000:
                    yield out
                    out, held = {c: [] for c in fields}, 0
            yield out

        return one

    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.warc.gz").text(path)
    spec = ", ".join(f"{c} {'long' if c == 'size' else 'string'}" for c in fields)
    return arrow_map(lines.select(F.col("value").cast("binary").alias("line")), make, spec)


def page_archives(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive pages without storing a payload twice, read the archives back and resolve their revisit records.

    Headers alone (id, url, digest, size) are shuffled by payload digest; revisit records are written from them, each with
    fresh headers that name the original response. Responses are the pages that no revisit header matches by id and
    digest: while these two columns of the revisits are small enough for Spark to broadcast, no payload is moved at all;
    beyond, rows meet by id and digest, which no frequent payload makes uneven. Returns a row for each row of pages:
    `id_col`, payload_bytes, payload_digest (bare hexadecimal SHA-1), record_type, refers_to and target_uri, as read from
    the archives; a revisit has the payload's size from its response. Null html is an empty payload; a null url gives no
    header. See resolve_revisits() for null and repeated ids. An empty table gives an empty one. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("uri"), F.coalesce(html_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    headers = written(rows.select("id", "uri", "digest", F.octet_length("payload").cast("long").alias("size")), "headers")
    again = written(resolve_revisits(headers, least).where("original IS NOT NULL"), "again")
    known = again.select(F.col("id").alias("_i"), F.col("digest").alias("_d")).distinct()
    first = rows.join(known, F.col("id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")), "left_anti")
    write_archives(first.withColumn("original", F.lit(None).cast("long")), one := new_path(spark, "responses"))
    write_archives(again.withColumn("payload", F.lit("")), two := new_path(spark, "revisits"))
    ident = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{ID}([-0-9]+)>', 1) AS bigint)")
    found = read_archives(spark, one).unionByName(read_archives(spark, two))
    found = found.select(ident("record_id").alias("id"), F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), "record_type", ident("refers_to").alias("refers_to"), "size", "sha1", "target_uri")
    found = written(found, "found")
    forget(headers, again, one, two)
    kept = found.where("record_type = 'response'").groupBy(F.col("sha1").alias("payload_digest")).agg(F.max("size").alias("_size"))
    out = found.where("record_type = 'revisit'").join(kept, "payload_digest", "left").withColumn("size", F.col("_size")).drop("_size").unionByName(found.where("record_type = 'response'"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri")

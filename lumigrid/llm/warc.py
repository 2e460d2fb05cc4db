"""WARC archives: a writer of gzip members and a splittable reader.

``write_archives`` writes one record per page, each a gzip member of its own, into files of about
``file_bytes`` in a folder all executors share; a task's file gets its name only when it is whole.
Of pages with equal payloads the one with the smallest id becomes a response record and the others
revisit records that refer to it.

``read_archives`` reads such files by byte ranges. A task looks for the gzip magic in its range,
takes a place as the start of a record if the member decodes to a WARC header from there, and owns
the records that start inside its range; the last one is read on past the end. A magic number in
compressed data doesn't decode to a header, so any split gives every record once.

Null htmls are empty payloads, of which the smallest id is the response as of any others. Ids may be
of any type that casts to a string and back; in headers they are percent-encoded, so that none can
break a line or a bracket, and null ids are told apart from empty ones. Null ids count as smaller
than any id only where a payload has no other. Repeated rows: of rows equal in id and payload one is the response, others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigrid.llm.store import materialise, shared_dir, spread_join

MIN_PAYLOAD, FILE_BYTES, RANGE_BYTES = 0, 64 << 20, 16 << 20
SCAN, FEED = 16 << 10, 64 << 10
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "page_id {id}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {id}, html binary"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -----------------------------------------------------------------------------------------


def assign_types(pages: DataFrame, id_col: str = "page_id", text: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(id, url, html, refers_to): refers_to is null for responses. Digests are compared in pairs of
    (digest, id); the payloads themselves move once, to their record type."""
    base = pages.select(F.col(id_col).alias("id"), F.col("url").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.coalesce(text, F.lit("")).alias("html"))
    digests = materialise(base.select("id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= min_payload), "warc-digests")
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # all empty payloads share one digest
    later = spread_join(digests, first, "digest", "inner").groupBy("id", "digest", "first").agg(F.count("*").alias("rows")).where("rows > 1 or not id <=> first")
    later = later.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "first", "rows")
    met = base.join(later, F.col("id").eqNullSafe(F.col("__id")) & (F.sha1("html") == F.col("__digest")), "left")
    if later.where("rows > 1 and __id <=> first").limit(1).count():  # rows equal in id and payload
        # rows that repeat nothing, of null ids too, are groups of their own
        alone = F.when(F.col("rows") > 1, 0).otherwise(F.monotonically_increasing_id())
        met = met.withColumn("__alone", alone)
        nth = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy("id", "__digest", "__alone").orderBy("url"))).otherwise(1)
        met = met.withColumn("nth", F.when(F.col("__id").eqNullSafe(F.col("first")) & F.col("__digest").isNotNull(), nth).otherwise(2))
    else:
        met = met.withColumn("nth", F.lit(2))
    refers = F.when(F.col("__digest").isNotNull() & (F.col("nth") > 1), F.col("first"))
    revisit = F.col("__digest").isNotNull() & (F.col("nth") > 1)
    return met.select("id", "url", "html", revisit.alias("revisit"), refers.alias("refers_to"))


def urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page(name: str) -> str | None:
    """The id in what ``urn`` wrote; null for none."""
    return unquote(name[10:-1]) if name.startswith("<urn:page:") else None


def record(page_id: str | None, url: str | None, html: bytes, revisit: bool, refers_to: str | None) -> bytes:
    """One WARC record: a response carries its payload, a revisit its digest and length only."""
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode('ascii')}",
        f"WARC-Payload-Digest: sha1:{digest32(html)}",
        f"X-Payload-Length: {len(html)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else html
    lines.append(f"Content-Length: {len(body)}")
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def write_archives(typed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows (path, size), one per file written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _filesystem(folder)
        fs.create_dir(at, recursive=True)
        out, size, done = None, 0, []

        def close() -> None:
            out[0].close()
            fs.move(out[1], out[2])
            done.append((out[3], size))

        for b in batches:
            columns = [c.to_pylist() if i != 2 else c for i, c in enumerate(b.columns)]
            for i in range(b.num_rows):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, size = (fs.open_output_stream(f"{at}/.{name}.open", compression=None), f"{at}/.{name}.open", f"{at}/{name}", f"{folder}/{name}"), 0
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(columns[0][i], columns[1][i], columns[2][i].as_py().encode(), columns[3][i], columns[4][i])) + z.flush()
                out[0].write(data)
                size += len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    named = typed.select(F.col("id").cast("string").alias("id"), "url", "html", "revisit", F.col("refers_to").cast("string").alias("refers_to"))
    return materialise(named.mapInArrow(run, "path string, size bigint"), "warc-files")


# --- reading -----------------------------------------------------------------------------------------


class Member:
    """A gzip member decoded step by step from an open file."""

    def __init__(self, file, at: int, size: int, seen: bytes = b""):
        self.file, self.next, self.size = file, at + len(seen), size
        self.z, self.text, self.feed = zlib.decompressobj(31), bytearray(), seen

    def more(self) -> bool:
        """Decode another piece; False at the member's end or the file's."""
        if self.z.eof:
            return False
        if not self.feed:
            if self.next >= self.size:
                return False
            self.file.seek(self.next)
            self.feed = self.file.read(min(FEED, self.size - self.next))
            self.next += len(self.feed)
        self.text += self.z.decompress(self.feed)
        self.feed = b""
        return True

    def header(self) -> dict[str, str] | None:
        """Header fields, or None if this is no WARC record."""
        seen = 0
        try:
            while (end := self.text.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
                seen = len(self.text)
                if len(self.text) >= 5 and not self.text.startswith(b"WARC/"):
                    return None
                if not self.more():
                    return None
        except zlib.error:
            return None
        if not self.text.startswith(b"WARC/"):
            return None
        lines = bytes(self.text[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        self.body_at = end + 4
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def body(self, length: int) -> bytes:
        while len(self.text) < self.body_at + length and self.more():
            pass
        if len(self.text) < self.body_at + length:
            raise OSError("a record's member ends before its content does")
        return bytes(self.text[self.body_at : self.body_at + length])


def records_in(file, size: int, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records (place, header, content) whose members start in [start, stop)."""
    at = start
    while at < min(stop, size):
        file.seek(at)
        data = file.read(min(SCAN, size - at))
        hit = data.find(MAGIC)
        if hit < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= stop:
            return
        member = Member(file, at, size, data[hit:])
        fields = member.header()
        if fields is None:
            at += 1
            continue
        content = member.body(int(fields.get("content-length", 0)))
        yield at, fields, content
        while member.more():
            pass
        at = member.next - len(member.z.unused_data)


def read_archives(files: DataFrame, id_type: str = "bigint", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of SCHEMA from archives (path, size). Length and digest of a response are taken from
    the payload read, those of a revisit from its header."""
    spark = files.sparkSession
    ranges = files.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {range_bytes}L)")).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = _filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for _, fields, content in records_in(file, size, start, start + range_bytes):
                        kind = fields.get("warc-type")
                        if kind == "response":
                            own = (len(content), digest32(content), "response", None, content)
                        else:
                            own = (int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, page(fields.get("warc-refers-to", "")), None)
                        rows.append((page(fields["warc-record-id"]), fields.get("warc-target-uri", "").encode("ascii", "replace").decode("unicode_escape"), *own))
                        held += len(content)
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    out = ranges.repartition(parts, "path", "start").mapInArrow(run, SCHEMA.format(id="string"))
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, folder: str | None = None, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write pages as archives and read the records back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(assign_types(pages, min_payload=min_payload), folder)
    return read_archives(files, pages.schema["page_id"].dataType.simpleString())


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """What the archives hold of every page."""
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_GROUP = "CAST(('0x' || substr(h, {at}, 5)) AS BIGINT)"
_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_GROUP.format(at=5 * g + 1)} >> {15 - 5 * k}) & 31 AS INT) + 1, 1)" for g in range(8) for k in range(4))

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_CHARS.replace("substr(h,", "substr(p.h,")} AS payload_digest,
  CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM p JOIN f ON p.h = f.h"""

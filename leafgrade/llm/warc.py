"""WARC archives: written by Spark tasks, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.llm.common import shared_path, shared_table

MAGIC, END = b"WARC/1.0\r\n", b"\r\n\r\n"
URN = "urn:leafgrade:page:"
FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$")
CANDIDATE = ("file string, start long, next long, page_id long, record_type string, refers_to long, payload_bytes long, "
             "payload_digest string, intact boolean")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record text per page row, without the blank line that ends it.

    Of rows with equal payloads of ``least_bytes`` or more, those with the
    largest page_id are responses and the others revisit it; only groups of
    several rows meet the pages again. Null html is an empty payload, a null
    page_id counts as the smallest.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html")), "size": F.octet_length("html")})
    heads = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(
        F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("head").isNotNull() & (F.coalesce(F.col("page_id") < F.col("head"), F.lit(True))), F.col("head"))
    rows = rows.join(heads, ["sha", "size"], "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html, head in zip(*(c.to_pylist() for c in batch.columns)):
                body = html.encode()
                uri = re.sub(r"[\x00-\x20<>\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
                lines = [MAGIC.decode().rstrip(), f"WARC-Type: {'response' if head is None else 'revisit'}",
                         f"WARC-Record-ID: <{URN}{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: <{uri}>",
                         f"WARC-Payload-Digest: sha1:{digest32(body)}", f"X-Payload-Length: {len(body)}", "Content-Type: text/html"]
                lines += [] if head is None else [f"WARC-Refers-To: <{URN}{head}>", "WARC-Profile: identical-payload-digest"]
                lines.append(f"Content-Length: {len(body) if head is None else 0}")
                out.append("\r\n".join(lines) + END.decode() + (html if head is None else ""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return rows.mapInArrow(records, "value string")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = 8192) -> None:
    """Writes the pages as gzipped WARC files of at most ``file_records`` records."""
    archive_records(pages, least_bytes).write.option("compression", "gzip").option("lineSep", END.decode()).option(
        "maxRecordsPerFile", file_records).text(path)


class _File:
    """Walks one file's pieces between magics and resolves candidate records as their payloads end."""

    def __init__(self, name: str):
        self.name, self.at, self.held, self.held_from = name, -len(MAGIC), bytearray(), 0
        self.open: list[tuple[int, int, int, dict[str, bytes]]] = []

    def piece(self, content: bytes) -> Iterator[tuple]:
        start, body = self.at, self.at + len(MAGIC)
        self.at = body + len(content)
        if self.open:
            self.held += MAGIC + content
        if start >= 0 and (head := content.find(END)) >= 0:
            fields = {k.lower().decode(): v for k, v in FIELD.findall(content[:head])}
            if "warc-type" in fields and fields.get("content-length", b"").isdigit() and len(fields["content-length"]) < 16:
                first = body + head + len(END)
                if not self.open:
                    self.held, self.held_from = bytearray(content), body
                self.open.append((start, first, first + int(fields["content-length"]) + len(END), fields))
        still = []
        for c in self.open:
            start, first, following, fields = c
            if following > self.at:
                still.append(c)
                continue
            payload = self.held[first - self.held_from : following - len(END) - self.held_from]
            if self.held[following - len(END) - self.held_from : following - self.held_from] == END:
                yield self.record(start, following, fields, payload)
        self.open = still
        if not still:
            self.held = bytearray()

    def record(self, start: int, following: int, fields: dict[str, bytes], payload: bytes) -> tuple:
        number = lambda k: int(m[1]) if (m := re.search(rb":(-?\d{1,19})>$", fields.get(k, b""))) else None
        kind, told = fields["warc-type"].decode("utf-8", "replace"), fields.get("warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
        if kind == "revisit":
            size = fields.get("x-payload-length", b"")
            return self.name, start, following, number("warc-record-id"), kind, number("warc-refers-to"), int(size) if size.isdigit() else None, told, True
        mine = digest32(payload)
        return self.name, start, following, number("warc-record-id"), kind, None, len(payload), mine, told in ("", mine)


def candidate_records(spark: SparkSession, path: str) -> DataFrame:
    """Every place with the magic and a plausible header: its offset, its successor's, and what its payload gives.

    Files are read in pieces between magics by Spark's text source; a task adds
    up the pieces' lengths to offsets. A piece waits only while a candidate's
    payload still runs. Candidates whose payload passes the end of the file or
    does not end in a blank line are none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        names = [f.split()[0] for f in CANDIDATE.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file is None or file.name != name:
                    file = _File(name)
                rows += file.piece(content.as_py())
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    pieces = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, CANDIDATE)


def chained(candidates: DataFrame) -> DataFrame:
    """The candidates that the chain from each file's start reaches.

    Pointer jumping: a round follows the present jumps from everything reached
    and then doubles the jumps, so a file of n records takes log2(n) rounds of
    equi joins on (file, offset). Candidates inside payloads are never a
    successor and fall away. Offsets only grow along a chain, so no round
    reaches an offset twice.
    """
    jumps = shared_table(candidates.select("file", "start", "next"), "warc-jumps")
    reached = jumps.where("start = 0").select("file", F.col("start").alias("at"))
    while not jumps.isEmpty():
        a, b = jumps.alias("a"), jumps.alias("b")
        step = reached.alias("r").join(a, (F.col("r.file") == F.col("a.file")) & (F.col("r.at") == F.col("a.start"))).select("a.file", F.col("a.next").alias("at"))
        reached = shared_table(reached.union(step), "warc-reached")
        jumps = shared_table(a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.start"))).select(
            "a.file", "a.start", "b.next"), "warc-jumps")
    return candidates.join(reached.withColumnRenamed("at", "start"), ["file", "start"])


def round_trip(pages: DataFrame, least_bytes: int = 0, file_records: int = 8192) -> DataFrame:
    """Writes pages as WARC files and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    The archives go to the session's shared folder. Sizes and digests of
    responses are computed from the payload that was read (``intact``: the
    header agrees), those of revisits are the header's. Magic inside a payload
    does no harm. Null html is an empty payload, null url ``about:blank``, a
    null page_id stays null; repeated rows give a record each, and rows that
    share the largest page_id of a payload are all responses. An empty table
    gives none. Other columns are not read.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, least_bytes, file_records)
    found = shared_table(candidate_records(spark, path), "warc-candidates")
    return chained(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")

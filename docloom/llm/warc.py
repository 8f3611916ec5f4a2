"""WARC archives: written by Spark's own file writer, read back by tasks that each scan a byte range.

Writer: every record is one gzip member; members are written through the text writer, whose line separator is
the last byte of a member (the high byte of its length field, zero below 16 MB; a longer record is closed by an
empty member). Files are committed as Spark commits any output, so a lost executor leaves no half archive.

Reader: the text source takes the gzip magic as its line separator. A task scans its byte range for the magic and
owns the candidates that start inside it, running over the end of the range to finish the last one. A candidate is
a member if it decodes; bytes that merely look like the magic are joined to the member they stand in. A member cut by
such bytes at the end of a range is put together in a second, small step over the fragments left.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import pieces, salted_join
from docloom.plans.stage import cut, stage_root

MAGIC = b"\x1f\x8b\x08"
LEAST = 100
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31)
_EMPTY = _EMPTY.compress(b"") + _EMPTY.flush()


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def record(kind: str, url: str, page_id: int | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To-Page: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict | None:
    """Headers, payload size, digest and payload of one decoded record; None where it isn't one."""
    if not data.startswith(b"WARC/"):
        return None
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {}
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    http, _, payload = rest[: int(size)].partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {"fields": fields, "payload": payload, "told": int(told[1]) if told else len(payload)}


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds payload (binary), payload_digest, record_type and refers_to to page_id and url.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses. Null
    html is an empty payload. Rows without page_id are revisits of a group that has one, else responses.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), payload.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256))
    groups = own.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where((F.col("n") > 1) & F.col("first").isNotNull()))
    joined = salted_join(own, groups, ["payload_digest"], "n", ["page_id", "url"], pages.count())
    other = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """One record per row under `path`."""

    def run(batches):
        for batch in pieces(batches):
            out = []
            for r in batch.to_pylist():
                made = member(record(r["record_type"], r["url"], r["page_id"], r["payload_digest"], len(r["payload"]), r["payload"], r["refers_to"]))
                out.append(made[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = classify(pages, least).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\x00").text(path)


def _inflate(data: bytes) -> tuple[bytes, bool]:
    """The record in a member and the empty members behind it; whether it is whole."""
    out = b""
    while data:
        z = zlib.decompressobj(31)
        try:
            out += z.decompress(data)
        except zlib.error:
            return out, False
        if not z.eof:
            return out, False
        data = z.unused_data
    return out, True


def _starts(data: bytes) -> bool:
    """Whether a candidate decodes to the header of a WARC record, or is an empty member."""
    z = zlib.decompressobj(31)
    try:
        got = z.decompress(data, 5)
    except zlib.error:
        return False
    return got == b"WARC/" or (not got and z.eof)


_ROW = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_LEFT = ["file", "block", "part", "value"]
_LEFT_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _row(data: bytes, payloads: bool, file: str) -> tuple:
    got = parse(data)
    if got is None:
        raise ValueError("a gzip member of %s holds no WARC record" % file)
    f = got["fields"]
    kind = f.get("warc-type", "")
    whole = kind == "response"
    digest = hashlib.sha256(got["payload"]).hexdigest() if whole else f.get("warc-payload-digest", "").rpartition(":")[2]
    number = lambda name: int(f[name]) if re.fullmatch(r"-?\d+", f.get(name, "")) else None
    size = len(got["payload"]) if whole else got["told"]
    return (number("warc-page-id"), size, digest, kind, number("warc-refers-to-page"), f.get("warc-target-uri"), got["payload"] if whole and payloads else None)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class _Range:
    """Candidates of one byte range, in order."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.part, self.held = file, block, 0, b""
        self.synced, self.first = block == 0, block == 0

    def take(self, value: bytes) -> tuple[bytes | None, tuple | None]:
        """A decoded member, or a fragment whose member starts in an earlier range."""
        if self.first:
            self.first = False
            if not value:
                return None, None
            raise ValueError("%s does not start with a gzip member" % self.file)
        self.part += 1
        value = MAGIC + value
        if not self.synced and not _starts(value):
            return None, (self.file, self.block, self.part, value)
        self.synced = True
        self.held += value
        data, whole = _inflate(self.held)
        if not whole:
            return None, None
        self.held = b""
        return data, None

    def end(self) -> list[tuple]:
        return [(self.file, self.block, self.part, self.held)] if self.held else []


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload).

    Digest and size of a response are computed from its payload; those of a revisit are what its record says.
    Empty members are skipped. Bytes that belong to no record raise an error.
    """
    raw = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    parts = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        """Candidates come in the order of the file, one range after the other."""
        here = None
        for batch in pieces(batches, 128):
            rows, left = [], []
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if here is None or (here.file, here.block) != (file, block):
                    left += here.end() if here else []
                    here = _Range(file, block)
                data, fragment = here.take(value or b"")
                if data:
                    rows.append(_row(data, payloads, file))
                if fragment:
                    left.append(fragment)
            yield _batch([(*r, None, None, None, None) for r in rows] + [(*[None] * len(_KINDS), *x) for x in left], _KINDS + _LEFT_KINDS, _NAMES + _LEFT)
        if here and here.held:
            yield _batch([(*[None] * len(_KINDS), *x) for x in here.end()], _KINDS + _LEFT_KINDS, _NAMES + _LEFT)

    def mended(batches):
        """Fragments that ranges left, in the order of the file."""
        file, held = None, b""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != file and held:
                    raise ValueError("bytes without a record at the end of %s" % file)
                file, held = r["file"], held + r["value"]
                data, whole = _inflate(held)
                if whole:
                    rows += [_row(data, payloads, file)] if data else []
                    held = b""
            yield _batch(rows, _KINDS, _NAMES)
        if held:
            raise ValueError("bytes without a record at the end of %s" % file)

    done = parts.mapInArrow(run, _ROW + ", file string, block bigint, part bigint, value binary")
    done = cut(done)
    rest = done.where("value is not null").select("file", "block", "part", "value").repartition("file").sortWithinPartitions("file", "block", "part")
    out = done.where("value is null").select(*_NAMES).unionByName(rest.mapInArrow(mended, _ROW))
    return out if payloads else out.drop("payload")


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes an archive of the pages to the shared folder and reads it back."""
    spark = pages.sparkSession
    path = f"{stage_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least)
    return read_warc(spark, path)

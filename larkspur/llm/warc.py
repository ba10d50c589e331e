"""WARC archives: written with an index, read back by byte ranges.

Writing. Each task writes the records of its rows one after another into archives of at most ``archive_bytes`` (a
larger record has an archive of its own) in the shared folder and returns an index row per record: archive,
offset, length, URL, digest. An archive's name holds the task attempt; the index, written by Spark's commit protocol,
names only the archives of the attempts that counted, so a lost executor leaves at most unused files.

Payloads that occur before are not stored again: of records with equal payloads (SHA-256 and length) the one with
the least id is a ``response``, the others are ``revisit`` records that refer to it. Only payloads that repeat are shuffled: a
bit map of fixed size names them, and a row that it does not know is written where it is read. Beyond the map's useful size more
rows are shuffled, never fewer.

Reading. Selected index rows are dealt by ranges of (archive, offset); a task sorts its own, merges ranges that
touch or lie within ``gap`` bytes of each other, up to ``span`` bytes of uncompressed records, and reads each once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.batches import slices
from larkspur.llm.lines import FILTER_BITS
from larkspur.sources.shared import materialize, new_path

INDEX = (
    "id long, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
RECORDS = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Record types, the revisit profile and the line end of WARC 1.1.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"


def digest_of(payload: bytes) -> str:
    """SHA-1 of the payload in base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> bytes:
    """A header value without line ends."""
    return " ".join((text or "").split("\n")).replace("\r", " ").encode("utf-8", "surrogatepass")


def record(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit has an empty block; it names the full payload by length, digest and record."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{id_}")).encode() + b">",
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + _line(url),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Page-ID: " + (b"" if id_ is None else str(id_).encode()),
        b"X-Payload-Length: " + str(len(payload)).encode(),
    ]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"X-Refers-To-Page-ID: " + str(refers_to).encode()]
    head += [b"Content-Type: text/html", b"Content-Length: " + str(len(block)).encode()]
    return END.join(head) + END + END + block + END + END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(END + END)
    lines = head.split(END)
    if lines[0] != VERSION:
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip(b" ").decode("utf-8", "surrogatepass")
    n = int(fields["content-length"])
    if rest[n:] != END + END:
        raise ValueError("a record has another length than its header says")
    return fields, rest[:n]


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder URI (file, hdfs, s3 or s3a, gs or a plain path)."""
    uri = f"s3://{uri.removeprefix('s3a://')}" if uri.startswith("s3a://") else uri
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = 0,
    archive_bytes: int = 256 << 20,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 6,
    folder: str | None = None,
) -> DataFrame:
    """Write a record per row, each a gzip member of its own of ``level`` (0: not compressed); returns the index (columns as in ``INDEX``), itself a table in the shared folder.

    Text payloads are written in UTF-8; null counts as empty. Payloads of under ``least_revisit`` bytes are always
    responses. Rows that repeat both the least id and the payload of a group are all responses; a null id is never the
    least, unless a group has no other (then its rows are responses). Line ends in URLs become spaces; a null URL is
    written as an empty one. Other columns are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    to = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    mark = F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload"))
    groups = rows.groupBy(mark.alias("mark")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and first is not null").select("mark", "first"), "warc-copies")
    place = F.pmod(F.xxhash64("mark"), F.lit(FILTER_BITS)).alias("p")
    words = groups.select(place).groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, m in words:
        bits[w] = m
    flag = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(to)
        system.create_dir(path, recursive=True)
        task, number, out, offset, name = TaskContext.get(), 0, None, 0, ""
        for batch in batches:
            for part in slices(batch, "payload"):
                made = []
                for id_, url, payload, refers_to, p in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if p is not None and flag.value[p >> 5] >> np.uint32(p & 31) & 1:
                        made.append((id_, url, *[None] * 7, payload))
                        continue
                    digest = digest_of(payload)
                    data = record(id_, url, payload, digest, refers_to, date)
                    data = gzip.compress(data, level, mtime=0) if level else data
                    if out is None or offset and offset + len(data) > archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc{'.gz' if level else ''}"
                        out, offset, number = system.open_output_stream(f"{path}/{name}", compression=None), 0, number + 1
                    out.write(data)
                    kind = "response" if refers_to is None else "revisit"
                    made.append((id_, url, f"{to}/{name}", offset, len(data), len(payload), digest, kind, refers_to, None))
                    offset += len(data)
                yield _batch(made, INDEX + ", payload binary")
        if out is not None:
            out.close()

    # rows whose payload may repeat come back as they are; the rest is written
    every = rows.withColumn("mark", mark).select("id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), place)
    found = materialize(every.mapInArrow(run, INDEX + ", payload binary"), "warc-index")
    index = found.where("archive is not null").drop("payload")
    if not words:
        return index
    held = found.where("archive is null").select("id", "url", "payload", mark.alias("mark")).join(groups, "mark", "left")
    revisit = (F.octet_length("payload") >= least_revisit) & ~F.coalesce(F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    held = held.select("id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), F.lit(None).cast("long").alias("p"))
    return index.unionByName(materialize(held.mapInArrow(run, INDEX + ", payload binary").drop("payload"), "warc-index"))


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(cols, types, strict=True)], list(names))


def read(index: DataFrame, *, gap: int = 64 << 10, span: int = 8 << 20, per_task: int = 64 << 20) -> DataFrame:
    """The records of the index rows in ``index`` (columns as in ``RECORDS``), parsed from the archives.

    A revisit has an empty payload; ``payload_bytes`` and ``payload_digest`` are those of the full one.
    The digest of each response is verified. Repeated index rows give repeated records; no rows give no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = "", None

        def records(ranges: list[tuple[int, int]]) -> list[tuple]:
            begin = ranges[0][0]
            source.seek(begin)
            data = source.read(max(o + n for o, n in ranges) - begin)
            out = []
            for o, n in ranges:
                one = data[o - begin : o - begin + n]
                h, block = parse(gzip.decompress(one) if name.endswith(".gz") else one)
                digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                if kind == "response" and digest_of(block) != digest:
                    raise ValueError(f"{name}: the record at {o} does not have the digest of its header")
                refers_to = h.get("x-refers-to-page-id")
                out.append((int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], kind, int(h["x-payload-length"]), digest, refers_to and int(refers_to), block))
            return out

        pending: list[tuple[int, int]] = []
        held = 0
        for batch in batches:
            for archive, offset, length, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pending and (archive != name or offset > sum(pending[-1]) + gap or held + weight > span):
                    yield _batch(records(pending), RECORDS)
                    pending, held = [], 0
                if archive != name:
                    if source is not None:
                        source.close()
                    system, path = open_folder(archive)
                    name, source = archive, system.open_input_file(path)
                pending.append((offset, length))
                held += weight
        if pending:
            yield _batch(records(pending), RECORDS)
        if source is not None:
            source.close()

    # the bytes a record holds in memory, not compressed
    weight = F.greatest("length", F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0))
    chosen = index.select("archive", "offset", "length", weight.alias("weight"))
    total = chosen.agg(F.sum("weight")).first()[0] or 0
    parts = max(-(-total // per_task), min(-(-total // (1 << 20)), index.sparkSession.sparkContext.defaultParallelism), 1)
    dealt = chosen.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, RECORDS)

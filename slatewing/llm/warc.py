"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame with a seek table ends each
file, so that one frame can be read without the others. The writer returns an index that maps every
record to its archive, its frame and its offset inside the decompressed frame.

Record ids are unique: ``urn:page:ID`` for the first row of an id and a payload, with the task and a
number behind it for further equal rows and for null ids (equal rows meet in one task, as the rows are
dealt by id and digest). A response holds an HTTP response whose body is the payload; a revisit holds
that response's head.

Defined results: a null payload is empty, a null page_id gives an urn with "null", equal rows give a
record each. Of equal payloads from ``dedup_from`` bytes on, the rows with the largest page_id are
responses and all others revisit it; a null id never is the largest unless all are null. An empty
table gives no archive and no record. Only the named columns of the input are read.
"""

from __future__ import annotations

import hashlib
import struct
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.llm.common import scratch, settle, table

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX_SCHEMA = "page_id long, record_id string, archive string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD_SCHEMA = "page_id long, record_id string, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, frame int, offset long"


def planned(pages: DataFrame, id_col: str, url_col: str, payload_col: str, dedup_from: int) -> DataFrame:
    """page_id, uri, payload, digest, n_bytes, refers_to. Only ids, digests and lengths are shuffled to
    find equal payloads; the payloads then meet the (page_id, refers_to) rows of the revisits alone."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    keyed = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    large = keyed.filter(F.col("n") >= dedup_from)
    # Settled, so that both sides of the join are plain shuffles and the rows of a hot digest can be split.
    groups = large.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and target is not null").select(F.col("digest").alias("target_digest"), "target")
    groups = settle(groups)
    revisits = large.join(groups, (F.col("digest") == F.col("target_digest")) & ~F.col("page_id").eqNullSafe(F.col("target"))).select(F.col("page_id").alias("revisit_id"), "digest", "target").distinct()
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    return rows.join(revisits.hint("merge"), rows.page_id.eqNullSafe(revisits.revisit_id) & (rows.payload_digest == revisits.digest), "left").select("page_id", "uri", "payload", "payload_digest", F.col("target").alias("refers_to"))


def record(name: str, uri, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the head of its full response and no payload."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def body_of(block: bytes) -> tuple[int, bytes]:
    """The payload's full length by the HTTP head, and what the block holds of it."""
    head, _, body = block.partition(b"\r\n\r\n")
    return int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"]), body


def parse(block: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the end of the record that begins at ``at``."""
    stop = block.index(b"\r\n\r\n", at)
    lines = block[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    return headers, block[begin:end], end + 4


class FrameWriter:
    """Gathers records into frames of about ``frame_bytes`` and writes each as an independent frame."""

    def __init__(self, sink, level: int, frame_bytes: int):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.at, self.open, self.size = 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it at which the record begins."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.open.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.at += len(packed)
            self.open, self.size = [], 0

    def close(self) -> list[tuple[int, int]]:
        """Ends the file with the seek table; gives each frame's start and packed length."""
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        starts, at = [], 0
        for packed, _ in self.frames:
            starts.append((at, packed))
            at += packed
        return starts


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """From the end of a seekable file: start, packed and plain length of each frame."""
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * width)
    raw, frames, at = source.read(n * width), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", raw, k * width)
        frames.append((at, packed, plain))
        at += packed
    return frames


def write_archives(rows: DataFrame, folder: str, level: int = 3, frame_bytes: int = 1 << 18, date: str | None = None) -> DataFrame:
    """Writes each partition of the planned rows to one file in a shared folder and returns the index.
    The payloads were dealt out by the join (or the scan) already, in parts of the session's usual
    size, and aren't shuffled again.

    A file appears under its name only when it is whole, and every attempt of a task has a name of its
    own, which the index of that attempt names: a lost executor or a second attempt leaves at most a
    file that no index entry points to, never a torn or a changed one. ``date`` is every record's
    WARC-Date, by default the time of this call."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.zst"
        attempt = f"{base}/.{name}.{os.getpid()}"
        sink = writer = None
        where, last = [], None
        for pdf in batches:
            for page_id, uri, payload, digest, refers in zip(pdf["page_id"], pdf["uri"], pdf["payload"], pdf["payload_digest"], pdf["refers_to"]):
                if writer is None:
                    sink = store.open_output_stream(attempt)
                    writer = FrameWriter(sink, level, frame_bytes)
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                again, last = (page_id, digest) == last, (page_id, digest)
                urn = f"urn:page:{'null' if page_id is None else page_id}" + (f":{context.partitionId()}-{len(where)}" if again or page_id is None else "")
                data = record(urn, None if pd.isna(uri) else uri, payload, digest, refers, date)
                where.append((page_id, urn, *writer.add(data), len(data)))
        if writer is None:
            return
        frames = writer.close()
        sink.close()
        store.move(attempt, f"{base}/{name}")
        for k in range(0, len(where), 10_000):
            part = where[k : k + 10_000]
            yield pd.DataFrame({
                "page_id": pd.array([x[0] for x in part], dtype="Int64"), "record_id": [x[1] for x in part], "archive": name,
                "frame": [x[2] for x in part], "frame_start": [frames[x[2]][0] for x in part], "frame_bytes": [frames[x[2]][1] for x in part],
                "offset": [x[3] for x in part], "length": [x[4] for x in part],
            })

    return rows.select("page_id", "uri", "payload", "payload_digest", "refers_to").mapInPandas(write, INDEX_SCHEMA)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record that the index names, read frame by frame from the archives. A response's length
    and digest are taken from its own bytes, a revisit's from its headers."""

    def read(batches):
        import zstandard
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        name, source, table = None, None, []
        for pdf in batches:
            out = []
            for archive, frame in zip(pdf["archive"], pdf["frame"]):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, store.open_input_file(f"{base}/{archive}")
                    table = seek_table(source, source.size())
                start, packed, plain = table[frame]
                source.seek(start)
                block, at = unpack.decompress(source.read(packed), max_output_size=plain), 0
                while at < len(block):
                    begin = at
                    headers, held, at = parse(block, begin)
                    urn = headers["WARC-Record-ID"][1:-1]
                    page, refers = urn.split(":")[2], headers.get("WARC-Refers-To")
                    (length, body), whole = body_of(held), refers is None
                    out.append((
                        None if page == "null" else int(page), urn, headers.get("WARC-Target-URI"), headers["WARC-Type"], None if whole else int(refers[1:-1].rpartition(":")[2]),
                        len(body) if whole else length, hashlib.sha1(body).hexdigest() if whole else headers["WARC-Payload-Digest"].removeprefix("sha1:"), archive, frame, begin,
                    ))
                if len(out) >= 5_000:
                    yield frame_of(out)
                    out = []
            if out:
                yield frame_of(out)
        if source:
            source.close()

    def frame_of(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=[x.split()[0] for x in RECORD_SCHEMA.split(", ")], dtype=object)
        return pdf.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "frame": "int32", "offset": "int64"})

    frames = index.select("archive", "frame").distinct()
    n = max(1, index.sparkSession.sparkContext.defaultParallelism)
    return frames.repartition(n * 2, "archive").sortWithinPartitions("archive", "frame").mapInPandas(read, RECORD_SCHEMA)


def fetch(folder: str, archive: str, frame_start: int, frame_bytes: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry, reading no other frame."""
    import zstandard
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{archive}") as source:
        source.seek(frame_start)
        block = zstandard.ZstdDecompressor().decompress(source.read(frame_bytes))
    headers, held, _ = parse(block, offset)
    return headers, body_of(held)[1]


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_from: int = 1000, level: int = 3, frame_bytes: int = 1 << 18) -> tuple[DataFrame, str]:
    """Writes all pages; gives the stored index and the folder that holds it and the archives."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = planned(pages, id_col, url_col, payload_col, dedup_from)
    index = write_archives(rows, f"{folder}/archives", level, frame_bytes)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index"), folder


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page of ``pages`` what its record says after a round trip through the archives."""
    index, folder = archive_pages(table(spark, sf_dir, "pages"))
    return read_archives(index, f"{folder}/archives").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op1_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        q as (select page_id, cast(octet_length(body) as bigint) as payload_bytes, sha1(body) as payload_digest from p),
        g as (select payload_digest as digest, max(page_id) as target from q where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, payload_digest,
               case when target is null or page_id = target then 'response' else 'revisit' end as record_type,
               case when target is null or page_id = target then null else target end as refers_to
        from q left join g on payload_digest = digest and payload_bytes >= 1000
    """
}
QUERIES = {"op1_warc": op1_warc}

"""WARC archives in seekable Zstandard bundles.

An archive is a run of independent Zstandard frames, each holding whole WARC/1.1 records, and ends in a
seek table in a skippable frame (little-endian: 0x184D2A5E, size, then per frame compressed and
decompressed size, then the number of frames, a zero byte and 0x8F92EAB1). Any Zstandard reader can
stream the file; with the seek table a single frame can be read. The index, a Parquet table (archive,
page_id, frame, offset, n_bytes), maps record identifiers to offsets inside a decompressed frame.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest page_id is written
as a response; the others are revisits that name it, its digest and their payload's length, and carry no
payload. Deduplication moves only digests and ids; payloads are shuffled once, to their writers.

Null html is an empty payload. Rows with a null page_id sort last; they never stand for others unless all
ids of a payload are null. Repeated rows each get a record, an empty table none; only
page_id, url and html are read, whatever else there is. Payloads are never shortened.

File names carry the attempt; only archives named by the index count, so lost executors and second
attempts leave at most unused files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs, partitions, shared_dir, small_batches, write_table

#: Payload bytes from which equal payloads are written once.
LEAST = 100
#: Decompressed bytes after which a frame is closed.
FRAME = 1 << 20
#: Fixed values of the formats: magic numbers, the WARC version and the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, page_id long, frame int, offset long, n_bytes long"


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, length: int, date: str) -> bytes:
    """One record; the page ids and the payload's length stand in extension fields."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "response":
        block += payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(length))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload; raises if the record is damaged."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.decode().split(": ", 1) if b": " in x else (x.decode().rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(file offset, compressed size, decompressed size) of each frame, from the end of an open file."""
    total = f.size()
    n, _, magic = struct.unpack("<IBI", f.read_at(9, total - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, out, at = f.read_at(8 * n, total - 9 - 8 * n), [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, packed, size))
        at += packed
    return out


def classify(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to. Page ids and digests are aggregated first;
    a payload that very many pages share meets its representative in a join that adaptive execution can split."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    marked = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    ids = pages.select(F.col(page_id).alias("__sd_id"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("__sd_n"))
    first = ids.filter(F.col("__sd_n") >= LEAST).groupBy("payload_digest").agg(F.min("__sd_id").alias("__sd_first"), F.count("*").alias("__sd_same"))
    out = marked.join(first.filter("__sd_same > 1"), "payload_digest", "left")
    other = (F.col("__sd_same") > 1) & ~F.col(page_id).eqNullSafe(F.col("__sd_first"))
    return out.withColumns({"record_type": F.when(other, "revisit").otherwise("response"), "refers_to": F.when(other, F.col("__sd_first"))}).drop("__sd_first", "__sd_same")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per task below ``folder``; returns the written index."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    rows = classify(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    # revisits carry no payload from here on
    rows = rows.withColumn("html", F.when(F.col("record_type") == "response", F.coalesce("html", F.lit(""))))
    rows = rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        packer = zstandard.ZstdCompressor(level=6, write_content_size=True)
        buffer, frames, places = bytearray(), [], []
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:

            def close() -> None:
                packed = packer.compress(bytes(buffer))
                out.write(packed)
                frames.append((len(packed), len(buffer)))
                buffer.clear()

            for b in batches:
                for i, u, h, n, digest, kind, ref in b.itertuples(index=False):
                    i, ref = (None if pd.isna(x) else int(x) for x in (i, ref))
                    raw = make_record(i, u, (h or "").encode("utf-8", "surrogatepass"), digest, kind, ref, int(n), date)
                    places.append((name, i, len(frames), len(buffer), len(raw)))
                    buffer += raw
                    if len(buffer) >= FRAME:
                        close()
                if places:
                    yield frame_of(places)
                    places = []
            if buffer:
                close()
            out.write(seek_table(frames))

    def frame_of(places: list[tuple]) -> pd.DataFrame:
        got = pd.DataFrame(places, columns=["archive", "page_id", "frame", "offset", "n_bytes"])
        return got.astype({"page_id": "Int64"})

    return write_table(rows.mapInPandas(write, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read the records of ``index`` rows back, each frame once: page_id, payload_bytes, payload_digest,
    record_type, refers_to (and payload). Lengths and digests of payloads are computed from what is read;
    those of revisits come from their headers."""
    dealt = index.repartition(partitions(index.sparkSession), "archive", "frame").sortWithinPartitions("archive", "frame", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, path = open_fs(folder)
        unpacker = zstandard.ZstdDecompressor()
        now, raw = None, b""
        opened, frames = None, []  # the seek table of an archive is read once
        for b in batches:
            out = []
            for name, frame, offset, n in b.itertuples(index=False):
                if (name, frame) != now:
                    with fs.open_input_file(f"{path}/{name}") as f:
                        if name != opened:
                            opened, frames = name, read_seek_table(f)
                        at, packed, _ = frames[frame]
                        raw, now = unpacker.decompressobj().decompress(f.read_at(packed, at)), (name, frame)
                fields, payload = parse_record(raw[offset : offset + n])
                length, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response":
                    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload is damaged")
                ids = [int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                out.append((ids[0], length, digest, fields["WARC-Type"], ids[1], *([payload] if payloads else [])))
            got = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])])
            yield got.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.select("archive", "frame", "offset", "n_bytes").mapInPandas(read, schema + (", payload binary" if payloads else ""))


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read every record back."""
    folder = shared_dir(spark, "warc")
    return read_archives(write_archives(pages, folder), folder)


#: DuckDB twin of the query op10.
ORACLE_SQL = """
WITH p AS (SELECT row_number() OVER () AS k, page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, min(page_id) AS least, count(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM p LEFT JOIN r USING (payload_digest)
"""

"""WARC archives compressed record by record with a dictionary of their own.

An archive is held in memory until it is full (a bound on raw bytes), a
Zstandard dictionary is built from its records, and the file is written: a
leading skippable frame with the dictionary, then one frame for each record.
Payloads that stand elsewhere become revisit records.  Reading goes by the
files named in the manifest, one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.shared import commit_file, filesystem, new_folder, written

REVISIT_BYTES = 1000
#: Raw bytes after which an archive is closed, and of the records that its dictionary is built from.
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 4 << 20
#: A table of revisits (two longs and two texts of a record's head) up to this many rows is broadcast.
BROADCAST_ROWS = 50_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
READ_BYTES = 32 << 10
#: Fixed values of the .warc.zst convention and of Zstandard's formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def decided(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with payload_bytes, digest (hex SHA-1), record_type, refers_to and the referred page's url.

    Of equal payloads (by SHA-256) of at least ``least`` bytes one row of the
    largest page_id is the response, and the others revisit it; should that id
    stand more than once, the first such row in the order of the scan.  Rows
    without an id refer to one with an id, or are all responses.  The decision
    is made on row numbers and digests; html moves in no shuffle while at most
    BROADCAST_ROWS pages revisit.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("digest"), F.sha2(html.cast("binary"), 256).alias("equal"),
    )
    rows = written(rows, "warc-pages")
    light = rows.where(F.col("payload_bytes") >= least).select("row", "page_id", "url", "equal")
    top = F.max(F.struct("page_id", (-F.col("row")).alias("row"), "url")).alias("top")
    copies = light.groupBy("equal").agg(F.count("*").alias("n"), top).where("n > 1 AND top.page_id IS NOT NULL").select(F.col("equal").alias("e"), "top")
    copies = written(copies, "warc-copies")
    again = light.select("row", "equal").join(copies, F.col("equal") == F.col("e")).where(F.col("row") != -F.col("top.row"))
    again = written(again.select(F.col("row").alias("_row"), F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"), (-F.col("top.row")).alias("refers_row")), "warc-revisits")
    few = again.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(again) if few else again, F.col("row") == F.col("_row"), "left")
    revisit = F.col("_row").isNotNull()
    return joined.select(
        "row", "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to", "refers_url", "refers_row",
    )


def _record_id(number, digest: str) -> str:
    """The id of a record by the number of its row, or of an archive by that of its task and place; rows may share page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{number}/{digest}')}>"


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    clean = lambda v: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in v)
    lines = [f"{k}: {clean(v)}" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def record(row: dict, date: str = DATE) -> bytes:
    """The bytes of one page's response or revisit record."""
    page = None if row["page_id"] is None else str(row["page_id"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
    fields = [
        ("WARC-Record-ID", _record_id(row["row"], row["digest"])), ("WARC-Date", date), ("WARC-Target-URI", row["url"]), ("WARC-Payload-Digest", digest),
        ("X-Page-Id", page), ("X-Payload-Length", str(row["payload_bytes"])), ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["record_type"] == "response":
        return _record("response", fields, http + (row["html"] or "").encode())
    target = str(row["refers_to"])
    fields += [
        ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["refers_row"], row["digest"])), ("WARC-Refers-To-Target-URI", row["refers_url"]), ("X-Refers-To-Page-Id", target),
    ]
    return _record("revisit", fields, http)


def dictionary(records: list[bytes]):
    """A dictionary built from records taken evenly over the archive, or None if they hold too little.

    Of a record at most a quarter of SAMPLE_BYTES trains; the records themselves are written whole.
    """
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: SAMPLE_BYTES >> 2] for r in records[::step]]
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 8)
    if size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, sample, k=200, d=8)
    except zstandard.ZstdError:  # too few records to train on: their own bytes serve
        return zstandard.ZstdCompressionDict(b"".join(sample)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(sink, records: list[bytes]) -> None:
    """Writes the dictionary frame and one frame for each record."""
    import zstandard

    trained = dictionary(records)
    if trained is not None:
        data = trained.as_bytes()
        sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    for r in records:
        sink.write(packer.compress(r))


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    import zstandard

    rest, trained = source.read(8), None
    if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == SKIPPABLE_MAGIC:
        data = source.read(struct.unpack("<I", rest[4:])[0])
        known = data[:4] == struct.pack("<I", DICTIONARY_MAGIC)
        trained = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if known else zstandard.DICT_TYPE_RAWCONTENT)
        rest = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    while rest or (rest := source.read(READ_BYTES)):
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := source.read(READ_BYTES)):
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_pages(rows: DataFrame, folder: str) -> DataFrame:
    """Writes decided pages into archives below ``folder``; returns the manifest (file, n_records)."""

    def task(batches):
        from pyspark import TaskContext

        held, size, part, archives = [], 0, TaskContext.get().partitionId(), itertools.count()

        def close():
            info = _record("warcinfo", [("WARC-Record-ID", _record_id(f"{part}/{next(archives)}", "info")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n")
            system, draft, final = commit_file(folder, f"pages-{part:06d}", ".warc.zst")
            with system.open_output_stream(draft, compression=None) as sink:
                write_archive(sink, [info, *held])
            system.move(draft, final)
            return pa.RecordBatch.from_pylist([{"file": final, "n_records": len(held)}])

        for batch in (b.slice(a, 64) for b in batches for a in range(0, len(b), 64)):
            for row in batch.to_pylist():
                data = record(row)
                held.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return written(rows.mapInArrow(task, "file string, n_records long"), "warc-manifest")


def read_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per page record of the manifest's archives; a payload that doesn't fit its digest is an error."""
    files = manifest.repartition(max(1, min(manifest.count(), 10_000)), "file")
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def rows(file: str):
        with filesystem(folder)[0].open_input_stream(file, compression=None) as source:
            for data in read_archive(source):
                fields, block = parse(data)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                payload = block.partition(b"\r\n\r\n")[2]
                size = len(payload)
                if fields["WARC-Type"] == "revisit":
                    size = int(fields["X-Payload-Length"])
                elif hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"a payload of {file} doesn't fit its digest")
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731,B023
                yield {
                    "page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
                    "refers_to": number("X-Refers-To-Page-Id"), "url": fields.get("WARC-Target-URI"),
                }

    def task(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held = []
                for r in rows(file):
                    held.append(r)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    return files.mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame) -> DataFrame:
    """Writes every page and returns what is read back from the archives.

    Defined results: a null html is an empty payload, always a response; a null
    url leaves its field out; a null page_id stays null and refers to nothing;
    control characters of a url are percent-encoded; an empty table writes no
    archive.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return read_pages(write_pages(decided(pages), folder), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND place > 1 AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND place > 1 THEN top END AS refers_to
FROM p
"""

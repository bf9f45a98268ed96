"""Zstandard WARC archives: one frame per record, with the dictionary in a leading skippable frame.

An archive is one row (``archive`` binary) of about ``ARCHIVE_BYTES`` of records, so archives
go wherever Spark writes and reads. Its first frame is a skippable one that holds the
dictionary; every record is a zstd frame of its own made with it. The reader takes the
dictionary from there, decodes frame by frame and checks the version line, the header fields,
the lengths and the payload digest of every record.

Records of equal payload are written once: the record with the largest page_id is the
response, all others are revisits that carry no payload but refer to it.

Rules: a null html is an empty payload. Page ids are integers and distinct; a repeated row
gives a repeated record (the first one written of equal page_id is the response). A null
page_id is written without reference and read back as null. A null url is left out of the
header. Other columns are ignored. The dictionary is trained on a bounded sample; with too few
pages for training it is empty, and then there is no leading frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authorloom.llm import shared

ARCHIVE_BYTES = 1 << 20
SAMPLE_PAGES = 400
DICTIONARY_BYTES = 64 << 10
SKIPPABLE = 0x184D2A5D
LEVEL = 3


def train_dictionary(pages: DataFrame, n_pages: int = SAMPLE_PAGES, size: int = DICTIONARY_BYTES) -> bytes:
    """Compression dictionary from the first ``n_pages`` pages in hash order of page_id."""
    import zstandard

    chosen = pages.select("page_id").where("page_id is not null")
    chosen = shared.drawn(chosen, "page_id", n_pages)
    # the part of each page that the trainer sees is bounded; what is written is whole
    rows = pages.join(F.broadcast(chosen.distinct()), "page_id", "left_semi").select(
        "page_id", F.substring("html", 1, 1 << 14).alias("html")
    )
    samples = [(r.html or "").encode() for r in sorted(rows.limit(4 * n_pages).collect(), key=lambda r: r.page_id)]
    samples = [s for s in samples if len(s) > 8]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError as error:
        warnings.warn(f"archives are written without a dictionary: {error}", stacklevel=2)
        return b""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, digest: str, size: int) -> bytes:
    """One WARC record; ``payload`` is None for a revisit. The block is the payload alone."""
    kind = "response" if payload is not None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(size)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > "\x1f" else "%%%02X" % ord(c) for c in url)))
    if refers_to is not None:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    block = payload or b""
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


class ArchiveWriter:
    """Collects the frames of one archive."""

    def __init__(self, dictionary: bytes):
        import zstandard

        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=True).compress
        self.head = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
        self.frames: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        frame = self.compress(raw)
        self.frames.append(frame)
        self.size += len(frame)

    def close(self) -> bytes:
        archive = self.head + b"".join(self.frames)
        self.frames, self.size = [], 0
        return archive


PIECE = 1 << 13
"""Bytes that a reader takes at a time."""


def read_records(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one record each."""
    import zstandard

    at, given = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        if 8 + size > len(archive):
            raise ArchiveError("the dictionary frame is cut off")
        given = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=given)
    view = memoryview(archive)
    while at < len(archive):
        frame = reader.decompressobj()
        parts, end = [], at
        try:
            while not frame.eof and end < len(archive):  # what a frame leaves over is at most a piece
                piece = view[end : end + PIECE]
                parts.append(frame.decompress(piece))
                end += len(piece)
        except zstandard.ZstdError as error:
            raise ArchiveError(f"frame at byte {at}: {error}") from error
        if not frame.eof:
            raise ArchiveError(f"frame at byte {at} is cut off")
        yield b"".join(parts)
        at = end - len(frame.unused_data)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-cased name, block) of a record whose parts are all as they should be."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ArchiveError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"broken header line {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise ArchiveError("the block does not have the length that the header gives")
    if rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("no end of record")
    block = rest[:-4]
    if fields["warc-type"] == "response":
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if digest != digest_of(block) or fields.get("x-payload-length") != str(len(block)):
            raise ArchiveError("the payload is not the one that the header describes")
    return fields, block


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "payload_key", F.sha1(F.encode("html", "UTF-8"))
    )
    several = (
        keyed.groupBy("payload_key")
        .agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
        .where("n > 1 and newest is not null")
        .drop("n")
    )
    return keyed.join(several, "payload_key", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("newest"), F.col("newest")).alias("refers_to")
    )


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` as archives under ``path``."""
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages))  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(dictionary.value)
        for block in shared.blocks(batches, "html", archive_bytes):
            for row in block.to_pylist():
                payload = row["html"].encode()
                refers_to = row["refers_to"]
                body = payload if refers_to is None else None
                writer.add(
                    record(row["page_id"], row["url"], body, refers_to, digest_of(payload), len(payload))
                )
                if writer.size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["archive"])
        if writer.frames:
            yield pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["archive"])

    archives = with_references(pages).mapInArrow(run, "archive binary")
    archives.write.option("compression", "none").parquet(path)


READ = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of all records, in the columns of ``READ``; payload is null for revisits.

    Without ``payloads`` the column is null: everything is checked, but stays in the task."""

    def number(field: str | None) -> int | None:
        inner = (field or "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("payload", pa.binary()),
            ]
        )
        for batch in batches:
            for archive in batch.column("archive"):
                rows = []
                for fields, block in map(parse_record, read_records(archive.as_py())):
                    rows.append(
                        {
                            "page_id": number(fields["warc-record-id"]),
                            "url": fields.get("warc-target-uri"),
                            "record_type": fields["warc-type"],
                            "refers_to": number(fields.get("warc-refers-to")),
                            "payload_bytes": int(fields["x-payload-length"]),
                            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                            "payload": block if payloads and fields["warc-type"] == "response" else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives in
    the shared folder."""
    path = shared.new_table_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    archives = pages.sparkSession.read.schema("archive binary").parquet(path)
    return read_archives(archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def newest_first(rows: DataFrame) -> DataFrame:
    """Of repeated page_ids the first response, for readers that want one row per page."""
    order = Window.partitionBy("page_id").orderBy(F.col("record_type") != "response", "payload_digest")
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")

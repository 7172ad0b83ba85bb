"""Media columns: content-addressed payloads in tar shards, rows that point into them.

Texts are padded to 8-bit samples and stored losslessly as grey PNG images, 64 samples
a line. Each task appends the images it meets for the first time to tar shards in the
shared folder, named by their digest; rows carry digest, shard, offset and length.
Where several tasks have met and stored the same digest, one place is chosen for all rows. Metadata
columns are then filled by range reads of the stored bytes: the image header alone
gives width and height, a full read of each distinct image gives the payload's checks.

Shards are written under a name of the task attempt's own and closed before any row
points to them, so lost or repeated tasks leave whole shards and rows that agree.

Cases: null and empty texts are one line of zero bytes; equal texts share one place; an
empty table gives no rows and no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, scratch_uri, settled, text_bytes

LINE = 64
#: Bytes after which a shard is closed and the next begun.
SHARD_BYTES = 64 << 20
#: Texts whose place a task remembers; one that it meets again later is stored again.
KNOWN = 1_000_000
HEADER = 33  # of a PNG: signature and IHDR chunk
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """text with zero bytes appended up to a positive multiple of 64."""
    return text + b"\0" * (max(LINE, -(-len(text) // LINE) * LINE) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are the payload, 64 a line."""
    n = len(payload) // LINE
    lines = bytearray(n * (LINE + 1))  # each led by its filter type, 0
    for k in range(LINE):
        lines[k + 1 :: LINE + 1] = payload[k::LINE]
    head = struct.pack(">IIBBBBB", LINE, n, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 9)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from an image's first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def png_samples(image: bytes) -> bytes:
    """The samples of an image as png() makes it."""
    width, height, _ = png_header(image[:HEADER])
    at, data = HEADER, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = zlib.decompress(data)
    out = bytearray(width * height)
    for k in range(width):
        out[k::width] = lines[k + 1 :: width + 1]
    if lines[0 :: width + 1].strip(b"\0"):
        raise ValueError("filtered lines aren't written here")
    return bytes(out)


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a regular file."""
    head = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def store(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, uri: str) -> DataFrame:
    """Stores every text below uri; rows doc_id, n_bytes, digest (of the image), shard, offset, length."""

    def write(it):
        import pyarrow as pa

        out, size, known = None, 0, {}
        fs, root = store(uri)
        fs.create_dir(root, recursive=True)
        rows: list[tuple] = []
        name = ""

        def close():
            nonlocal out
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()
                out = None
            done, rows[:] = rows[:], []
            if len(known) > KNOWN:
                known.clear()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                key = hashlib.sha256(text).digest()
                place = known.get(key)
                if place is None:
                    if out is None:
                        name, size = f"shard-{uuid.uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{root}/{name}")
                    image = png(payload_of(text))
                    digest = hashlib.sha256(image).hexdigest()
                    out.write(tar_header(f"{digest}.png", len(image)))
                    out.write(image)
                    out.write(b"\0" * (-len(image) % 512))
                    place = known[key] = (digest, name, size + 512, len(image))
                    size += 512 + len(image) + -len(image) % 512
                rows.append((doc_id, len(text), *place))
            if size >= SHARD_BYTES or len(rows) >= 100_000:
                yield from close()
        yield from close()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), write, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def read_back(places: DataFrame, uri: str) -> DataFrame:
    """Metadata and checks of stored images, from places (digest, shard, offset, length): width, height
    by a range read of the header alone, then the payload's checks by one of the whole image."""

    def read(it):
        import pyarrow as pa

        fs, root = store(uri)
        shard, file = None, None
        for b in it:
            out = []
            for digest, name, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if name != shard:
                    if file is not None:
                        file.close()
                    shard, file = name, fs.open_input_file(f"{root}/{name}")
                width, height, bits = png_header(file.read_at(HEADER, offset))
                image = file.read_at(length, offset)
                samples = png_samples(image)
                levels = len(set(samples))
                feature = f"png:{width}x{height}x{bits}:levels={levels}:mean={sum(samples) * 1000 // len(samples)}"
                out.append((digest, width, height, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-LINE:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            i32, i64, s = pa.int32(), pa.int64(), pa.string()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (s, i32, i32, i64, s, i64, i64, s, s))], names=["digest", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        if file is not None:
            file.close()

    return arrow_map(places, read, "digest string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, uri: str | None = None) -> DataFrame:
    """docs' rows with media columns; shards are kept below uri, else below the shared checkpoint folder."""
    spark = docs.sparkSession
    uri = uri or scratch_uri(spark, "media")
    rows = settled(write_shards(docs, uri))
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    read = read_back(places.repartition("shard").sortWithinPartitions("shard", "offset").select("digest", "shard", "offset", "length"), uri)
    columns = read.join(places, "digest")
    return rows.select("doc_id", "n_bytes", "digest").join(columns, "digest")

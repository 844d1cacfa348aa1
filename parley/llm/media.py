"""Media columns: payloads live in tar shards under their digest; rows carry digest, shard, offset and length.

`store` writes each task's payloads once into shards of a bounded size and returns one reference per row. `canonical` points
all rows of one digest to one object, so that an object is read once however many rows have it. `fill_metadata` reads only
the fixed-size header of each object, `read_features` the whole of it.

Null text: as the empty text, whose payload is all padding. Repeated rows and equal texts: the same object. Very long
texts: one object each. An empty table gives no shard and no row. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payload bytes in a row of the image: 64 pixels of three 8-bit samples.
ROW = 192
WIDTH = 64
#: A shard is closed once it has this many bytes.
SHARD_BYTES = 64 << 20
#: References that a task remembers for texts that come again.
SEEN = 100_000
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """The payload of a text: spaces appended up to a positive multiple of a row."""
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload as an 8-bit RGB image of 64 pixels a row, without loss."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of an image made by to_png; raises if a checksum is wrong."""
    _, height, _ = png_header(media[:HEADER])
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """32 hexadecimal digits: the mean sample of each of 16 equal spans."""
    spans = np.frombuffer(payload, np.uint8).reshape(16, -1)
    return "".join(f"{x:02x}" for x in np.rint(spans.mean(axis=1)).astype(int))


class ShardWriter:
    """Writes tar shards one after the other; the name of each holds the task attempt, so that a repeated task clashes with none."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.number, self.out, self.at = name, 0, None, 0

    def add(self, member: str, data: bytes) -> tuple[str, int]:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.shard, self.at = f"{self.name}-{self.number:04d}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.shard}")
            self.number += 1
        info = tarfile.TarInfo(member)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        place = (self.shard, self.at + len(head))
        self.at += len(head) + len(data) + -len(data) % 512
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every row's payload; the shards are written when this is evaluated.

    Write the result down (`shared.stored`) before it is used twice: another evaluation writes other shards.
    """
    from parley.llm.shared import slices

    def run(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get()
        writer = ShardWriter(folder, f"shard-{task.partitionId():06d}-{task.taskAttemptId()}")
        seen: dict[bytes, tuple] = {}
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                payload = padded(raw)
                key = hashlib.sha256(payload)
                ref = seen.get(key.digest())
                if ref is None:
                    media = to_png(payload)
                    ref = (*writer.add(f"{key.hexdigest()}.png", media), len(media))
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[key.digest()] = ref
                rows.append((len(raw), key.hexdigest(), *ref))
            n, digest, shard, offset, length = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        writer.close()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def canonical(refs: DataFrame) -> DataFrame:
    """One object for each digest: digest, shard, offset, length."""
    first = refs.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.*")


def _reader(folder: str):
    """A function that reads a range of a shard; keeps the last file open."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    last: dict[str, pa.NativeFile] = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in last:
            for f in last.values():
                f.close()
            last.clear()
            last[shard] = fs.open_input_file(f"{path}/{shard}")
        return last[shard].read_at(length, offset)

    return read


def in_order(objects: DataFrame) -> DataFrame:
    """Objects dealt out by place, so that a task reads one stretch of a few shards."""
    return objects.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def fill_metadata(objects: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bit_depth from the first 33 bytes of each object; nothing else is read."""

    def run(batches):
        read = _reader(folder)
        for batch in batches:
            found = [png_header(read(s, o, HEADER)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            columns = [pa.array([x[k] for x in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bit_depth"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema)
    return objects.mapInArrow(run, f"{kept}, width int, height int, bit_depth int")


def read_features(objects: DataFrame, folder: str) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        read = _reader(folder)
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                media = read(shard, offset, length)
                payload = from_png(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return objects.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text's payload, then reads each distinct object back: its header for the metadata, its whole for the features."""
    from parley.llm.shared import stored, work_dir

    folder = work_dir(docs.sparkSession, "shards")
    refs = stored(store(docs, folder), "media-refs")
    objects = in_order(canonical(refs))
    found = read_features(objects, folder).join(fill_metadata(objects, folder).select("digest", "width", "height", "bit_depth"), "digest")
    return refs.select("doc_id", "n_bytes", "digest").join(found, "digest").drop("digest")

"""Media columns: texts as lossless 8-bit images in archives, and a Spark data source that streams them back.

An archive is a ZIP file of stored (uncompressed) members; each member is an 8-bit greyscale PNG, 64 samples wide, whose
samples are the text's UTF-8 bytes, padded with zeros. The archive's directory lists the members' offsets. The source
plans byte ranges over the archives of a folder, or of a written list, from their sizes alone; a task reads an archive's directory, takes
the members that begin in its range, and streams them through one open file in Arrow batches bounded in bytes. A member
whose read fails is read again by its offset, alone, without the others.

Files are reached through pyarrow's file systems, so the folder may lie in any store that those know.
"""

from __future__ import annotations

import hashlib
import json
import random
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import need, new_path

WIDTH = 64
#: Bytes of an archive after which a task begins the next one, of a planned range, and of a batch of payloads.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 128 << 20, 32 << 20, 8 << 20
_PNG = b"\x89PNG\r\n\x1a\n"


def pad(payload: bytes) -> bytes:
    """Zeros appended up to a positive multiple of the width."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """An 8-bit greyscale PNG, ``WIDTH`` samples a row, without filtering."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; checks every checksum."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        part = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("checksum of a PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unexpected PNG header")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected PNG filter")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a difference hash of an 8 x 9 reduction of the image."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    p = counts[counts > 0] / len(a)
    rows = a.reshape(-1, WIDTH)
    edge = np.linspace(0, len(rows), 9).astype(int)
    bands = np.stack([rows[s : max(e, s + 1)].sum(axis=0, dtype=np.int64) for s, e in zip(edge, edge[1:], strict=False)])
    cells = bands[:, :63].reshape(8, 9, 7).sum(axis=2)
    bits = int("".join("1" if x else "0" for x in (cells[:, 1:] > cells[:, :-1]).ravel()), 2)
    return f"{a.mean():.4f}:{a.std():.4f}:{-(p * np.log2(p)).sum():.4f}:{bits:016x}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _seekable(path: str):
    fs, own = _open(path)
    return fs.open_input_file(own)


def write_archives(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Writes every row's text to archives under ``path``; returns one row for each archive (archive, members, bytes).

    The keys go, as JSON, into the member's comment, with the text's length. Archives have names of their own, so that a
    task that runs twice leaves an archive more; only those in the returned list belong to the result.
    """
    need(df, [text, *keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        out, archive, name, members = None, None, "", 0

        def close() -> Iterator[pa.RecordBatch]:
            archive.close()
            size = out.tell()
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [name], "members": pa.array([members], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for *key, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/.{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                payload = payload or b""
                info = zipfile.ZipInfo(f"{members:08d}.png", (1980, 1, 1, 0, 0, 0))
                info.comment = json.dumps([len(payload), *key]).encode()
                archive.writestr(info, to_png(pad(payload)))
                members += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield from close()
                    archive = None
        if archive is not None:
            yield from close()

    source = df.select(*(F.to_json(F.struct(F.col(k))).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).cast("binary").alias("_text_"))
    return source.mapInArrow(run, "archive string, members long, bytes long")


class _Range(InputPartition):
    def __init__(self, archive: str, start: int, stop: int) -> None:
        self.archive, self.start, self.stop = archive, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.manifest = options["path"].rstrip("/"), options.get("manifest")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 4))

    def partitions(self) -> list[_Range]:
        sizes = self._listed() if self.manifest else self._found()
        out = [_Range(f"{self.path}/{name}", a, min(a + self.range_bytes, size)) for name, size in sizes for a in range(0, size, self.range_bytes)]
        return out or [_Range("", 0, 0)]

    def _listed(self) -> list[tuple[str, int]]:
        fs, root = _open(self.manifest)
        table = pq.read_table(root, columns=["archive", "bytes"], filesystem=fs)
        return sorted(zip(table["archive"].to_pylist(), table["bytes"].to_pylist(), strict=True))

    def _found(self) -> list[tuple[str, int]]:
        fs, root = _open(self.path)
        files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in files if f.is_file and f.base_name.endswith(".zip") and not f.base_name.startswith("."))

    @staticmethod
    def _take(f, path: str, info: zipfile.ZipInfo) -> bytes:
        """A member's bytes from an open archive, by its own offset, checked."""
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at byte {info.header_offset} of {path}")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(info.header_offset + 30 + name + extra)
        data = f.read(info.compress_size)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise OSError(f"member {info.filename} of {path} is damaged")
        return data

    def _member(self, path: str, info: zipfile.ZipInfo) -> bytes:
        """A member read again, alone; each try opens the archive anew. The last failure is raised."""
        for attempt in range(self.retries):
            try:
                with _seekable(path) as f:
                    return self._take(f, path, info)
            except OSError:
                if attempt == self.retries - 1:
                    raise
                time.sleep(min(5.0, 0.05 * 2**attempt * (1 + random.random())))
        raise OSError(f"member {info.filename} of {path} can't be read")

    def _members(self, path: str, start: int, stop: int) -> list[zipfile.ZipInfo]:
        """The archive's directory; each try opens the archive anew, and one cut short by a fault (no archive) is tried again too."""
        for attempt in range(self.retries):
            try:
                with _seekable(path) as f, zipfile.ZipFile(f) as z:
                    return [m for m in z.infolist() if start <= m.header_offset < stop]
            except (OSError, EOFError, zipfile.BadZipFile):
                if attempt == self.retries - 1:
                    raise
                time.sleep(min(5.0, 0.05 * 2**attempt * (1 + random.random())))
        raise OSError(f"{path} can't be read")

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        path, rows, size, stream = partition.archive, [], 0, None
        try:
            for m in self._members(path, partition.start, partition.stop):  # one stream through the range; only a member that fails is fetched apart
                try:
                    stream = stream or _seekable(path)
                    data = self._take(stream, path, m)
                except OSError:
                    data = self._member(path, m)
                n, *keys = json.loads(m.comment)
                rows.append((json.dumps(keys), m.filename, m.header_offset, n, data))
                size += len(data)
                if size >= self.batch_bytes:
                    yield _batch(rows)
                    rows, size = [], 0
        finally:
            if stream:
                stream.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, names, offsets, sizes, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["keys", "member", "offset", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: one row for each member of the folder's archives.

    Options: manifest (Parquet rows archive, bytes: read only these), rangeBytes (of a partition), batchBytes (of a batch), retries (of a member).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "keys string, member string, offset long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:  # noqa: ARG002
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(path)


def decode(df: DataFrame) -> DataFrame:
    """The members' keys with the features of their stored samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column(2):
                image = image.as_buffer()
                samples = from_png(image.to_pybytes())
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), image.size, hashlib.sha256(image).hexdigest(), features(samples)))
            size, sha, tail, media, media_sha, feature = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(media, pa.int64()), pa.array(media_sha, pa.string()), pa.array(feature, pa.string())], names=["keys", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.select("keys", "n_bytes", "media").mapInArrow(run, "keys string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """Stores every text of ``df`` as media in archives of the shared folder, and returns the features read back.

    One row per row of ``df``: doc_id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. A null text is an empty one, which is stored as 64 zeros. Null ids and repeated rows keep a
    member each; other columns are ignored; an empty table gives an empty result. Texts aren't shuffled.
    """
    need(df, [text, doc_id])
    spark = df.sparkSession
    path = path or new_path(spark, "media")
    listed = f"{path}-list"
    write_archives(df, path, text, (doc_id,)).write.parquet(listed)
    found = decode(read_archives(spark, path, manifest=listed))
    kind = df.schema[doc_id].dataType
    key = F.from_json(F.get_json_object("keys", "$[0]"), f"`{doc_id}` {kind.simpleString()}")[doc_id]
    return found.select(key.alias(doc_id), *(c for c in found.columns if c != "keys"))

"""The block format of keyed record tables, as a Spark data source named "keyed_blocks".

Read: one partition per chunk; the chunk directory is made from headers and tails alone, so dimension filters and row
counts don't touch the data. Write: one file per task, a chunk per dimension value, records packed little-endian and
cut into raw-deflated blocks.

    blocks.register(spark)
    df.write.format("keyed_blocks").option("formats", "Q,c").option("columns", "pos,strand").option("dims", "chrom").mode("append").save(folder)
    spark.read.format("keyed_blocks").load(folder_or_file)

Files are opened by path in the driver and the executors, so the folder must be mounted on all of them.
Rows of a chunk get `id`, their place from 1. Fixed-width text loses its NUL padding.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import spark_type

# Fixed values of the format: marks of file, chunk and block, its version, the raw size of a block, the end-of-file bytes.
FILE_MARK, CHUNK_MARK, BLOCK_MARK, VERSION = b"BMZIP", b"MC", b"MB", 1.0
BLOCK_SIZE = 65_535
END_MARK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

# Format codes as NumPy types, little-endian.
_NUMPY = {"B": "u1", "H": "<u2", "I": "<u4", "L": "<u4", "Q": "<u8", "b": "i1", "h": "<i2", "i": "<i4", "l": "<i4", "q": "<i8", "f": "<f4", "d": "<f8", "c": "S1"}


def _text(f) -> str:
    return f.read(f.read(1)[0]).decode()


def _put_text(s: str) -> bytes:
    raw = s.encode()
    if len(raw) > 255:
        raise ValueError("names and dimension values have at most 255 bytes")
    return bytes([len(raw)]) + raw


@dataclass
class Header:
    formats: list[str]
    columns: list[str]
    dims: list[str]
    message: str = ""
    total: int = field(default=0, compare=False)  # bytes before the end mark; 0 while a file is being written

    @property
    def record(self) -> struct.Struct:
        return struct.Struct("<" + "".join(self.formats))

    def pack(self, total: int = 0) -> bytes:
        raw = self.message.encode()
        parts = [FILE_MARK, struct.pack("<fQH", VERSION, total, len(raw)), raw, bytes([len(self.formats)]), *map(_put_text, self.formats)]
        return b"".join([*parts, *map(_put_text, self.columns), bytes([len(self.dims)]), *map(_put_text, self.dims)])

    @staticmethod
    def read(f) -> Header:
        if f.read(5) != FILE_MARK:
            raise ValueError("not a file of this format")
        _, total, n = struct.unpack("<fQH", f.read(14))
        message = f.read(n).decode()
        count = f.read(1)[0]
        formats = [_text(f) for _ in range(count)]
        columns = [_text(f) for _ in range(count)]
        return Header(formats, columns, [_text(f) for _ in range(f.read(1)[0])], message, total)

    def numpy_type(self) -> np.dtype:
        """The packed record; fixed-width text loses its NUL padding by itself."""
        kind = lambda c: f"S{c[:-1] or 1}" if c.endswith("s") else _NUMPY[c]
        return np.dtype([(n, kind(c)) for n, c in zip(self.columns, self.formats, strict=True)])

    def schema(self) -> StructType:
        from ..model import schema_from_formats

        fields = schema_from_formats(self.formats, self.columns, self.dims).fields
        return StructType([*fields[: len(self.dims)], StructField("id", LongType()), *fields[len(self.dims) :]])


@dataclass
class Chunk(InputPartition):
    path: str
    start: int
    size: int
    rows: int
    blocks: int
    values: tuple


def directory(path: str) -> tuple[Header, list[Chunk]]:
    """Header and chunks of a file, from its headers and tails. A file that was cut off or not finished is refused."""
    out = []
    with open(path, "rb") as f:
        head = Header.read(f)
        at, size_of_file = f.tell(), os.fstat(f.fileno()).st_size
        if head.total + len(END_MARK) != size_of_file:
            raise ValueError(f"{path} isn't finished: {size_of_file} bytes")
        while f.tell() < head.total:
            if f.read(2) != CHUNK_MARK:
                raise ValueError(f"a chunk of {path} is damaged")
            start = f.tell() - 2
            (size,) = struct.unpack("<Q", f.read(8))
            f.seek(start + size)
            raw_size, blocks = struct.unpack("<QQ", f.read(16))
            f.seek(8 * blocks, 1)
            out.append(Chunk(path, start, size, raw_size // head.record.size, blocks, tuple(_text(f) for _ in head.dims)))
        if f.read() != END_MARK:
            raise ValueError(f"{path} has no end mark")
    return head, out


def block_directory(chunk: Chunk, head: Header) -> list[tuple[int, int, int]]:
    """(offset in the file, place of the first record that starts in it, its 1-based row id) of every block, from the
    tail; no block is read."""
    with open(chunk.path, "rb") as f:
        f.seek(chunk.start + chunk.size + 16)
        packed = np.frombuffer(f.read(8 * chunk.blocks), "<u8")
    at, within = (packed >> np.uint64(16)).astype(np.int64), (packed & np.uint64(0xFFFF)).astype(np.int64)
    ids = (np.arange(chunk.blocks) * BLOCK_SIZE + within) // head.record.size + 1
    return list(zip(at.tolist(), within.tolist(), ids.tolist(), strict=True))


def arrays(chunk: Chunk, head: Header, together: int = 64):
    """The chunk's records as structured arrays, `together` blocks at a time; a record may straddle two blocks."""
    kind, rest = head.numpy_type(), b""
    with open(chunk.path, "rb") as f:
        f.seek(chunk.start + 10)
        parts = []
        for k in range(chunk.blocks):
            if f.read(2) != BLOCK_MARK:
                raise ValueError("a block is damaged")
            (size,) = struct.unpack("<H", f.read(2))
            parts.append(zlib.decompress(f.read(size - 6), -15))
            f.read(2)
            if len(parts) == together or k == chunk.blocks - 1:
                raw = b"".join([rest, *parts])
                n = len(raw) // kind.itemsize
                yield np.frombuffer(raw, kind, n)
                rest, parts = raw[n * kind.itemsize :], []


def records(chunk: Chunk, head: Header):
    """Tuples of a chunk, text decoded."""
    text = [k for k, c in enumerate(head.formats) if c == "c" or c.endswith("s")]
    for rows in arrays(chunk, head):
        for row in rows.tolist():
            if text:
                row = list(row)
                for k in text:
                    row[k] = row[k].decode()
            yield tuple(row)


class ChunkWriter:
    """Writes chunks to a file object, one after the other."""

    def __init__(self, f, head: Header):
        self.f, self.head, self.values = f, head, None
        self.seen: set[tuple] = set()
        f.write(head.pack())

    def write(self, values: tuple, row: tuple) -> None:
        if values != self.values:
            self._close_chunk()
            if values in self.seen:
                raise ValueError(f"the rows of {values} don't lie together")
            self.seen.add(values)
            self.values, self.start, self.buffer, self.raw, self.offsets = values, self.f.tell(), bytearray(), 0, []
            self.f.write(CHUNK_MARK + struct.pack("<Q", 0))
        self.buffer += self.head.record.pack(*row)
        while len(self.buffer) >= BLOCK_SIZE:
            self._block()

    def _block(self) -> None:
        part = bytes(self.buffer[:BLOCK_SIZE])
        del self.buffer[:BLOCK_SIZE]
        size = self.head.record.size
        self.offsets.append(self.f.tell() << 16 | -self.raw % size)
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        self.f.write(BLOCK_MARK + struct.pack("<H", len(body) + 6) + body + struct.pack("<H", len(part)))
        self.raw += len(part)

    def _close_chunk(self) -> None:
        if self.values is None:
            return
        if self.buffer:
            self._block()
        end = self.f.tell()
        self.f.write(struct.pack("<QQ", self.raw, len(self.offsets)) + struct.pack(f"<{len(self.offsets)}Q", *self.offsets) + b"".join(map(_put_text, self.values)))
        after = self.f.tell()
        self.f.seek(self.start + 2)
        self.f.write(struct.pack("<Q", end - self.start))
        self.f.seek(after)
        self.values = None

    def close(self) -> None:
        self._close_chunk()
        total = self.f.tell()
        self.f.write(END_MARK)
        self.f.seek(len(FILE_MARK) + 4)
        self.f.write(struct.pack("<Q", total))


def _listed(spark, path: str) -> list[tuple[Header, Chunk]]:
    local = path.removeprefix("file://")
    files = sorted(glob.glob(f"{local}/*.cz")) if os.path.isdir(local) else [local]
    return [(head, c) for head, chunks in map(directory, files) for c in chunks]


def chunk_table(spark, path: str):
    """Chunks of the files of a folder, from headers and tails alone: dims, file, offset, size, tail, nblocks, nrows."""
    found = _listed(spark, path)
    dims = found[0][0].dims if found else []
    kinds = ", ".join([*(f"`{d}` string" for d in dims), "file string, offset long, size long, tail long, nblocks long, nrows long"])
    return spark.createDataFrame([(*c.values, c.path, c.start, c.size, c.start + c.size, c.blocks, c.rows) for _, c in found], kinds)


def block_table(spark, path: str):
    """Blocks of the files of a folder: dims, file, number in the chunk, offset, place of the first record that starts
    in it, that record's row id. Each chunk's tail is read in a task of its own."""
    found = _listed(spark, path)
    dims = found[0][0].dims if found else []
    kinds = ", ".join([*(f"`{d}` string" for d in dims), "file string, block long, offset long, within long, first_id long"])

    def run(batches):
        for b in batches:
            rows = []
            for row in b.to_pylist():
                head, chunk = found[row["id"]]
                rows += [(*chunk.values, chunk.path, k, *x) for k, x in enumerate(block_directory(chunk, head), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*dims, "file", "block", "offset", "within", "first_id"])

    return spark.range(0, len(found), 1, max(1, min(len(found), 1000))).mapInArrow(run, kinds)


def header(path: str) -> Header:
    """Formats, columns, dimensions and message of one file."""
    with open(path.removeprefix("file://"), "rb") as f:
        return Header.read(f)


class KeyedBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_blocks"

    def _files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(f"{path}/*.cz")) if os.path.isdir(path) else [path]
        if not found:
            raise FileNotFoundError(f"no file of this format in {path}")
        return found

    def schema(self) -> StructType:
        return directory(self._files()[0])[0].schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._files(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        split = lambda k: [x for x in self.options.get(k, "").split(",") if x]
        head = Header(split("formats"), split("columns"), split("dims"), self.options.get("message", ""))
        for c in head.formats:
            spark_type(c)
        return _Writer(self.options["path"].removeprefix("file://"), head, overwrite)


def register(spark) -> None:
    """Make the format known to a session, with filters on dimensions pushed down to chunks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedBlocks)


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], schema: StructType):
        self.files, self.wanted, self.schema = files, [], to_arrow_schema(schema)

    def pushFilters(self, filters):
        """Equality of a dimension chooses chunks; everything else is left to Spark."""
        dims = directory(self.files[0])[0].dims
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in dims:
                self.wanted.append((dims.index(f.attribute[0]), f.value))
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        out = [c for path in self.files for c in directory(path)[1]]
        return [c for c in out if all(c.values[k] == v for k, v in self.wanted)] or [Chunk("", 0, 0, 0, 0, ())]

    def read(self, chunk: Chunk):
        if chunk.path:
            with open(chunk.path, "rb") as f:
                head = Header.read(f)
            n = 0
            for rows in arrays(chunk, head):
                ids = pa.array(np.arange(n + 1, n + len(rows) + 1), pa.int64())
                own = [pa.array([v], pa.string()).take(pa.array(np.zeros(len(rows), np.int64))) for v in chunk.values]
                cols = [pa.array(rows[c].tolist(), pa.binary()).cast(pa.string()) if rows.dtype[c].kind == "S" else pa.array(rows[c]) for c in head.columns]
                made = pa.RecordBatch.from_arrays([*own, ids, *cols], [*head.dims, "id", *head.columns])
                yield pa.RecordBatch.from_arrays([made.column(f.name).cast(f.type) for f in self.schema], schema=self.schema)
                n += len(rows)


@dataclass
class _Done(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, head: Header, overwrite: bool):
        self.folder, self.head, self.overwrite = folder, head, overwrite

    def write(self, rows) -> _Done:
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/.{uuid.uuid4().hex}.tmp"
        text = [c == "c" or c.endswith("s") for c in self.head.formats]
        out = None
        for row in rows:
            if out is None:
                out = ChunkWriter(io.open(path, "wb+"), self.head)
            out.write(tuple(row[d] for d in self.head.dims), tuple((row[c] or "").encode() if t else row[c] for c, t in zip(self.head.columns, text, strict=True)))
        if out is None:
            return _Done(None)
        out.close()
        out.f.close()
        return _Done(path)

    def commit(self, messages) -> None:
        done = [m.path for m in messages if m is not None and m.path]
        if self.overwrite:
            for old in glob.glob(f"{self.folder}/*.cz"):
                os.remove(old)
        for path in done:
            os.replace(path, f"{self.folder}/{os.path.basename(path)[1:-4]}.cz")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)

"""Token-id files: byte or bit planes of fixed-size id blocks, zstandard, chunk index.

File format (little-endian):

    magic "IDPLANE1"
    per chunk: its planes, each a zstandard frame, one after another
    index: per chunk  offset u64, ids u32, planes u32, then a u32 size per plane
    tail: chunks u32, ids u64, index offset u64, magic

A chunk holds ``BLOCK_IDS`` ids (the last one fewer).  Byte mode splits the
ids' four bytes into four planes, bit mode their 32 bits into 32 packed
planes; like bits stand together and the high planes compress to nothing.

Writing: documents are range-partitioned by doc_id and sorted, a task writes one
file and returns one row per document (file, start in the file, count).
Those rows are the commit: they are written as a table by Spark, and only
files named there are read.  A task that is run again writes another file.
A document's global start is its file's offset (a running sum over one row
per file) plus its start in the file.  Files lie in the shared folder, through
pyarrow's file systems.

Defined results: null text counts as empty (one id, the end); null doc_ids
come last; repeated rows are written each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import text_slices
from .tokens import ID_BYTES, default_tokenizer_path, document_ids

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 15
LEVEL = 3
_TAIL = struct.Struct("<IQQ8s")
_CHUNK = struct.Struct("<QII")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style URI or a local path."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", uri)))


# -------------------------------------------------------------------- planes
def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, ID_BYTES)
    if mode == "byte":
        return [octets[:, k].tobytes() for k in range(ID_BYTES)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * ID_BYTES)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == ID_BYTES:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class PlaneWriter:
    """Appends ids to one file; keeps at most a block of them in memory."""

    def __init__(self, stream, mode: str = "byte", block: int = BLOCK_IDS):
        self.stream, self.mode, self.block = stream, mode, block
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.held, self.ids, self.index = [], 0, 0, []
        self.at = stream.write(MAGIC)

    def append(self, packed: bytes) -> None:
        self.waiting.append(packed)
        self.held += len(packed) // ID_BYTES
        self.ids += len(packed) // ID_BYTES
        if self.held >= self.block:
            ids = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(ids[i: i + self.block])
            self.waiting, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.packer.compress(p) for p in to_planes(ids, self.mode)]
        self.index.append((self.at, len(ids), [len(p) for p in planes]))
        for p in planes:
            self.at += self.stream.write(p)

    def close(self) -> None:
        if self.held:
            self._chunk(np.frombuffer(b"".join(self.waiting), "<u4"))
        for offset, n, sizes in self.index:
            self.stream.write(_CHUNK.pack(offset, n, len(sizes)) + struct.pack(f"<{len(sizes)}I", *sizes))
        self.stream.write(_TAIL.pack(len(self.index), self.ids, self.at, MAGIC))
        self.stream.close()


class PlaneReader:
    """Random access by id position, one chunk in memory at a time."""

    def __init__(self, stream):
        self.stream, self.unpacker = stream, zstandard.ZstdDecompressor()
        size = stream.size()
        if size < len(MAGIC) + _TAIL.size:
            raise ValueError("not an id-plane file")
        stream.seek(size - _TAIL.size)
        chunks, self.ids, at, magic = _TAIL.unpack(stream.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not an id-plane file")
        stream.seek(at)
        raw = stream.read(size - _TAIL.size - at)
        self.index, pos = [], 0
        for _ in range(chunks):
            offset, n, planes = _CHUNK.unpack_from(raw, pos)
            pos += _CHUNK.size
            self.index.append((offset, n, struct.unpack_from(f"<{planes}I", raw, pos)))
            pos += 4 * planes
        self.bounds = np.cumsum([0] + [n for _, n, _ in self.index])
        self.current, self.chunk = -1, None

    def _load(self, k: int) -> np.ndarray:
        if k != self.current:
            offset, n, sizes = self.index[k]
            self.stream.seek(offset)
            raw, planes, at = self.stream.read(sum(sizes)), [], 0
            for s in sizes:
                planes.append(self.unpacker.decompress(raw[at: at + s]))
                at += s
            self.current, self.chunk = k, from_planes(planes, n)
        return self.chunk

    def read(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start .. start+n-1, piece by piece."""
        if start + n > self.ids:
            raise ValueError("past the end of the file")
        k = int(np.searchsorted(self.bounds, start, side="right")) - 1
        while n > 0:
            low = start - self.bounds[k]
            piece = self._load(k)[low: low + n]
            yield piece
            start, n, k = start + len(piece), n - len(piece), k + 1


# ------------------------------------------------------------------- operator
ROWS_PER_FILE = 200_000      # documents of a file, at most about (more files on small tables)
INDEX_SCHEMA = "doc_id long, part int, file string, file_start long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, mode: str = "byte",
                      text: str = "text") -> DataFrame:
    """Write the ids of all documents below ``folder`` in ascending doc_id
    order; returns the committed index with each document's global ``start``."""
    tokenizer = tokenizer or default_tokenizer_path()

    def write(batches):
        part = TaskContext.get().partitionId()
        name, out = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.idp", None
        for batch in text_slices(batches):
            if out is None:
                fs, path = open_store(name)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = PlaneWriter(fs.open_output_stream(path), mode)
            starts, counts = [], []
            for value in batch.column(1).to_pylist():
                ids = document_ids(value, tokenizer)
                starts.append(out.ids)
                counts.append(len(ids) // ID_BYTES)
                out.append(ids)
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n, pa.string()),
                 pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "part", "file", "file_start", "n_tokens"])
        if out is not None:
            out.close()

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_PER_FILE))
    # equal (or no) ids are dealt on by their text, copies of a text by their row
    order = [F.col("doc_id").asc_nulls_last(), F.col("print"), F.col("row")]
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"),
                        F.xxhash64(F.col(text)).alias("print"), F.monotonically_increasing_id().alias("row"))
            .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    index = cut_lineage(rows.mapInArrow(write, INDEX_SCHEMA), "token_index")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))       # one row per file
    offsets = offsets.select("part", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("ahead"))
    return index.join(offsets, "part").withColumn("start", F.col("ahead") + F.col("file_start")).drop("ahead")


def read_token_files(index: DataFrame) -> DataFrame:
    """Read every document of the index back: doc_id, start, n_tokens, ids_crc32."""
    def read(batches):
        name, reader = None, None
        for batch in batches:
            crcs = []
            for file, start, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if file != name:
                    fs, path = open_store(file)
                    name, reader = file, PlaneReader(fs.open_input_file(path))
                crc = 0
                for piece in reader.read(start, n):
                    crc = zlib.crc32(piece.tobytes(), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4),
                                              pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = (index.select("doc_id", "start", "file", "file_start", "n_tokens")
            .repartition("file").sortWithinPartitions("file", "file_start"))
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_query(docs: DataFrame) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "token_files")
    return read_token_files(write_token_files(docs, folder))

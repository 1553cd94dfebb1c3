"""Token ids in binary files of independent zstandard frames.

A file holds, in this order:

- one or more zstandard frames per document, each of at most FRAME_IDS ids, little-endian
  unsigned 32-bit;
- a skippable frame (magic 0x184D2A50) with the document index: for each document its id (64 bits),
  whether it has one (8 bits), its first frame (32 bits) and its number of ids (64 bits);
- a skippable frame (magic 0x184D2A5E) with the seek table of the public zstandard seekable
  format: per frame its compressed size, its size, and the low 32 bits of the XXH64 of its
  content, then the number of frames, a descriptor and the magic 0x8F92EAB1. The document index
  stands in it as a frame of size 0.

Any zstandard reader can decompress the file; a reader of single documents reads the table at the
end and only the frames it asks for. A table of the written files (the manifest) says which files
count: files of failed or repeated attempts have names of their own and are in no manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from sigmatide.llm.common import documents_of, row_digest
from sigmatide.llm.tokens import encoder
from sigmatide.session import partitions_of, qualified, shared_folder, staged

END_ID = 1
FRAME_IDS = 1 << 18
# Fixed values of the public formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80  # descriptor bit: the table has checksums
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("ids", "<u8")])
TABLE = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
BATCH_BYTES = 8 << 20
GROUP_BYTES, PIECES_KEPT = 4 << 20, 500_000  # text encoded together, pieces remembered; only speed and memory depend on them
MANIFEST = "file string, part int, n_docs long, n_ids long, first_id long, last_id long"


def checksum(content: bytes) -> int:
    return xxh64_intdigest(content) & 0xFFFFFFFF


class FileWriter:
    """Writes documents one after the other; frames leave memory as they are made."""

    def __init__(self, sink, level: int = 3):
        self.sink = sink
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(self.table), len(ids) // 4))
        for at in range(0, len(ids), 4 * FRAME_IDS):
            part = ids[at:at + 4 * FRAME_IDS]
            packed = self.pack(part)
            self.sink.write(packed)
            self.table.append((len(packed), len(part), checksum(part)))
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        index = np.array(self.index, INDEX).tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array([*self.table, (len(index) + 8, 0, checksum(b""))], TABLE)
        body = table.tobytes() + struct.pack("<IBI", len(table), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        self.sink.close()


class FileReader:
    """Reads the tables at the end of a file, then only the frames of the documents asked for."""

    def __init__(self, source, size: int):
        self.source = source
        self.unpack = zstandard.ZstdDecompressor().decompress
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        start = size - 9 - n * TABLE.itemsize
        table = np.frombuffer(self._at(start, n * TABLE.itemsize), TABLE)
        self.ends = np.cumsum(table["packed"].astype(np.int64))
        self.table = table[:-1]
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.index = np.frombuffer(
            self._at(int(self.starts[-1]) + 8, int(table["packed"][-1]) - 8), INDEX)
        self.frames = np.append(self.index["frame"], len(self.table)).astype(np.int64)
        self.first_ids = np.concatenate(([0], np.cumsum(self.index["ids"].astype(np.int64))))

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def document(self, row: int) -> bytes:
        """Ids of the document in this row of the index."""
        parts = []
        for frame in range(self.frames[row], self.frames[row + 1]):
            entry = self.table[frame]
            part = self.unpack(self._at(int(self.starts[frame]), int(entry["packed"])),
                               max_output_size=int(entry["size"]))
            if len(part) != entry["size"] or checksum(part) != entry["check"]:
                raise ValueError(f"frame {frame} does not match its checksum")
            parts.append(part)
        return b"".join(parts)


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a qualified folder."""
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame,
    tokenizer_file: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> tuple[str, DataFrame]:
    """(folder, manifest): every document's ids, then ``end_id``, in ascending order of doc_id.

    Documents are range partitioned by id, so each task writes one file of a range of ids and
    files follow each other by ``part``. Null text is empty and has the end id only. Null ids
    come first; rows that repeat an id are kept, in the order of a hash of the text. An empty
    table gives an empty manifest. Ids are integers; others are refused. ``folder`` defaults to a new one in the shared
    folder; without a scheme it lies on Spark's default file system, for tasks as for Spark itself.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer, as the files keep ids in 64 bits")
    folder = qualified(spark, folder or shared_folder(spark, "token-files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part = None, TaskContext.get().partitionId()
        encode, end = encoder(tokenizer_file, GROUP_BYTES, PIECES_KEPT), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, ids in zip(batch.column(0), encode(batch.column(1))):
                if writer is None:
                    fs, path = _place(folder)
                    fs.create_dir(path, recursive=True)
                    name = f"{part:06d}-{uuid.uuid4().hex}.ids.zst"
                    writer = FileWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                writer.add(doc_id.as_py(), ids + end)
        if writer is not None:
            writer.close()
            known = [entry[0] for entry in writer.index if entry[1]]
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([name]), "part": pa.array([part], pa.int32()),
                "n_docs": pa.array([len(writer.index)], pa.int64()),
                "n_ids": pa.array([writer.n_ids], pa.int64()),
                "first_id": pa.array([min(known, default=None)], pa.int64()),
                "last_id": pa.array([max(known, default=None)], pa.int64())})

    rows = documents_of(docs, id_col, text_col).withColumn("row", row_digest(F.col("text")))
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    written = ordered.select("doc_id", "text").mapInArrow(run, MANIFEST)
    return folder, staged(written, "token-manifest")


def _rows(reader: FileReader, wanted: Iterable[int], base: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        values = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds)], ["doc_id", "start", "n_tokens", "ids"])

    for row in wanted:
        entry, ids = reader.index[row], reader.document(row)
        rows.append((int(entry["doc_id"]) if entry["known"] else None,
                     base + int(reader.first_ids[row]), int(entry["ids"]), ids))
        size += len(ids)
        if size > BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    yield batch()


def read_token_files(folder: str, manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the written documents, or of those in ``doc_ids`` only.

    ``start`` counts the ids of all documents before. Files are dealt to as many tasks as there are files, up to the
    number of shuffle partitions; a task reads its files one by one and verifies checksums. With ``doc_ids`` only
    the files whose range of ids holds one of them are opened. ``manifest`` has one row a file, which bounds
    the single-task window over it.
    """
    spark = manifest.sparkSession
    folder = qualified(spark, folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", "first_id", "last_id",
                            F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    if doc_ids is not None:
        asked = F.array(*map(F.lit, doc_ids)).cast("array<long>")
        files = files.filter(F.exists(asked, lambda i: i.between(F.col("first_id"), F.col("last_id"))))
    files = files.select("file", "base")
    tasks = max(1, min(manifest.count(), partitions_of(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = f"{path}/{name}"
                with fs.open_input_file(file) as source:
                    reader = FileReader(source, fs.get_file_info(file).size)
                    wanted = range(len(reader.index)) if doc_ids is None else np.flatnonzero(
                        np.isin(reader.index["doc_id"], doc_ids) & (reader.index["known"] == 1))
                    yield from _rows(reader, wanted, base)

    return files.repartition(tasks).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")

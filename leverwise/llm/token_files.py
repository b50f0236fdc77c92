"""Token ids in seekable zstandard files (operator 2).

A file is a row of independent zstandard frames holding ids as little-endian unsigned 32-bit integers, then a skippable
frame with the document index, then the seek table of the public seekable format: for each frame its compressed size,
its size and a checksum (lower half of xxh64 of the ids), the number of frames and the magic number. A reader takes the
table from the end of the file, the index by the table, and decompresses the frames of the documents it wants.

Each task writes its file under a name of its own and reports it in its result row; only reported files are part of
the set, so a task that is repeated or lost leaves at most a file that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverwise.llm.chunks import encoder
from leverwise.llm.common import ids_and_texts, map_arrow, new_folder, prepare

FILE = "word_bpe_49k.json"
END_ID = 1
# Ids in a frame; a longer document goes on in the next frame.
FRAME_IDS = 64 * 1024
LEVEL = 1

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
HEADER = struct.Struct("<II")
INDEX_MAGIC = 0x184D2A50

MANIFEST = "part int, path string, documents long, ids long, low long, high long"


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends documents to a stream; holds one frame and the index."""

    def __init__(self, stream):
        self.stream = stream
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self) -> None:
        data = np.concatenate(self.waiting).astype("<u4").tobytes()
        packed = self.pack.compress(data)
        self.stream.write(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))
        self.waiting, self.size = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        while len(ids):
            if self.size and self.size + len(ids) > FRAME_IDS:
                self._frame()
            self.waiting.append(ids[:FRAME_IDS])
            self.size += len(self.waiting[-1])
            ids = ids[FRAME_IDS:]
            if self.size >= FRAME_IDS:
                self._frame()

    def close(self) -> None:
        if self.size:
            self._frame()
        named = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        body = self.pack.compress(named.tobytes() + ids.tobytes() + np.array(self.counts, "<u8").tobytes())
        body = struct.pack("<Q", len(self.ids)) + body
        self.stream.write(HEADER.pack(INDEX_MAGIC, len(body)) + body)
        self.entries.append((HEADER.size + len(body), 0, _checksum(body)))
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        table += FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(HEADER.pack(SKIPPABLE_MAGIC, len(table)) + table)


class Reader:
    """Documents of one file by position; only the frames they lie in are read and decompressed."""

    def __init__(self, stream):
        self.stream = stream
        self.unpack = zstandard.ZstdDecompressor()
        size = stream.size()
        n, _, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the file has no seek table")
        table = self._bytes(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
        self.entries = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.entries[:-1, 1] // 4)])
        body = self._bytes(int(self.at[-2]) + HEADER.size, int(self.entries[-1, 0]) - HEADER.size)
        if _checksum(body) != self.entries[-1, 2]:
            raise ValueError("the document index is damaged")
        (documents,) = struct.unpack_from("<Q", body)
        index = self.unpack.decompress(body[8:])
        named = np.frombuffer(index, np.uint8, documents)
        ids = np.frombuffer(index, "<i8", documents, documents)
        self.ids = pa.array(ids, mask=named == 0)
        self.counts = np.frombuffer(index, "<u8", documents, 9 * documents).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frames_read = 0
        self.held = (-1, np.zeros(0, np.uint32))

    def _bytes(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            data = self.unpack.decompress(self._bytes(int(self.at[k]), int(self.entries[k, 0])))
            if _checksum(data) != self.entries[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self.held = (k, np.frombuffer(data, "<u4"))
        return self.held[1]

    def document(self, i: int) -> Iterator[np.ndarray]:
        """The ids of document i, frame by frame."""
        at, end = int(self.starts[i]), int(self.starts[i] + self.counts[i])
        k = int(np.searchsorted(self.first, at, "right")) - 1
        while at < end:
            begin, stop = int(self.first[k]), int(self.first[k + 1])
            yield self.frame(k)[at - begin : end - begin]
            at, k = min(end, stop), k + 1


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_tokens(documents: DataFrame, folder: str, path: str = FILE, end_id: int = END_ID) -> list:
    """Encode all texts, write them in ascending order of id, and return the manifest, one row for each file.

    Order: by doc_id, rows without id first; rows that repeat an id by a hash of their text. A null text is empty: only
    the end id is written. The folder must be one that driver and executors share. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, writer, stream = encoder(path), None, None
        part = TaskContext.get().partitionId()
        place, base = _place(folder)
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            if batch.num_rows and writer is None:
                place.create_dir(base, recursive=True)
                stream = place.open_output_stream(name, compression=None)
                writer = Writer(stream)
            names = batch.column(0).to_pylist()
            for low, high, ids, of in held.encode(batch.column(1)):
                for row in range(low, high):
                    own = ids[of[row - low] : of[row - low + 1]]
                    writer.add(names[row], np.append(own, np.uint32(end_id)))
        if writer is None:
            return
        writer.close()
        stream.close()
        known = [i for i in writer.ids if i is not None]
        row = [[part], [f"{folder}/{name.rsplit('/', 1)[1]}"], [len(writer.ids)], [sum(writer.counts)],
               [min(known, default=None)], [max(known, default=None)]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch(
            [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
            names=["part", "path", "documents", "ids", "low", "high"],
        )

    keyed = ids_and_texts(documents).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return sorted(map_arrow(ordered.select("doc_id", "text"), MANIFEST, work, f"encoder {path}").collect(), key=lambda row: row.part)


def read_back(spark: SparkSession, manifest: list) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The manifest has one row for each file; its running sum gives the number of ids before each file.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, path = _place(row["path"])
                with place.open_input_file(path) as stream:
                    reader = Reader(stream)
                    crc = np.zeros(len(reader.counts), np.int64)
                    for i in range(len(crc)):
                        value = 0
                        for ids in reader.document(i):
                            value = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), value)
                        crc[i] = value
                    yield pa.record_batch(
                        [reader.ids, pa.array(reader.starts + row["before"]), pa.array(reader.counts), pa.array(crc)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before, rows = 0, []
    for row in manifest:
        rows.append((row.path, before))
        before += row.ids
    files = prepare(spark).createDataFrame(rows, "path string, before long")
    if rows:
        files = files.repartition(len(rows))
    return map_arrow(files, "doc_id long, start long, n_tokens long, ids_crc32 long", work)


def fetch(spark: SparkSession, manifest: list, wanted: list[int]) -> DataFrame:
    """(doc_id, ids, frames_read) of a stated list of documents; other frames stay compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                place, path = _place(name)
                with place.open_input_file(path) as stream:
                    reader = Reader(stream)
                    for i in np.flatnonzero(np.isin(reader.ids.fill_null(-1).to_numpy(), wanted)).tolist():
                        if not reader.ids[i].is_valid:
                            continue
                        ids = np.concatenate(list(reader.document(i)))
                        yield pa.record_batch(
                            [pa.array([reader.ids[i].as_py()]), pa.array([ids.tolist()], pa.list_(pa.int64())),
                             pa.array([reader.frames_read])],
                            names=["doc_id", "ids", "frames_read"],
                        )

    paths = [(r.path,) for r in manifest if r.low is not None and any(r.low <= i <= r.high for i in wanted)]
    files = prepare(spark).createDataFrame(paths, "path string")
    if paths:
        files = files.repartition(len(paths))
    return map_arrow(files, "doc_id long, ids array<long>, frames_read long", work)


def token_output(documents: DataFrame, path: str = FILE, end_id: int = END_ID) -> DataFrame:
    """Write the whole table to a new shared folder and read the files back; an empty table gives no rows."""
    spark = documents.sparkSession
    return read_back(spark, write_tokens(documents, new_folder(spark, "tokens"), path, end_id))

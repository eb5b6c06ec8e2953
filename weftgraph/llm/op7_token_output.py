"""Token ids in a binary format of bit or byte planes.

A file holds ids in blocks of a fixed size. Each block is transposed into planes (byte 0 of all its ids,
then byte 1, ... or bit 0, bit 1, ...), each plane is compressed with zstandard, and a plane of zeros
takes no room. An index of the chunks (place, ids, size of each plane) and a footer end the file, so any
id is found by reading one chunk.

``write_tokens`` sorts documents by id over range partitions, each of which writes one file to the shared
folder. Its name holds the attempt that wrote it, and so do the documents' places, which are returned: a file
that a lost or repeated attempt left is never read. ``read_tokens`` streams the files back, a chunk at a time.

Defined results: null texts and empty texts hold the end id alone; rows with equal doc_id keep their
multiplicity, in the order of their texts' hashes (ranges cut through them, so that an id that many rows
share fills no single file); null ids come first; an empty table gives no files and no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import fresh_path, open_uri, small_batches, stored, table
from weftgraph.llm.tokens import END_BYTES, default_vocabulary, encoder

MAGIC = b"WEFTPLN1"
BLOCK = 1 << 16
FOOTER = struct.Struct("<QIIB3x8s")


class PlaneWriter:
    """Writes ids to a binary file object, block by block."""

    def __init__(self, out, block: int = BLOCK, planes: str = "byte", level: int = 3):
        import zstandard

        self.out, self.block, self.bits = out, block, planes == "bit"
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.n_waiting = 0
        self.index: list[tuple] = []
        self.at = out.write(MAGIC) and len(MAGIC)

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            raw = b"".join(self.waiting)
            size = self.block * 4
            full = len(raw) // size * size
            for a in range(0, full, size):
                self._chunk(raw[a : a + size])
            self.waiting, self.n_waiting = [raw[full:]], (len(raw) - full) // 4

    def _chunk(self, raw: bytes) -> None:
        octets = np.frombuffer(raw, np.uint8).reshape(-1, 4)
        if self.bits:
            planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            planes = np.ascontiguousarray(octets.T)
        sizes, start = [], self.at
        for p in planes:
            data = self.zip.compress(p.tobytes()) if p.any() else b""
            self.out.write(data)
            sizes.append(len(data))
            self.at += len(data)
        self.index.append((start, len(octets), *sizes))

    def close(self) -> None:
        if self.n_waiting:
            self._chunk(b"".join(self.waiting))
        n = 32 if self.bits else 4
        index = np.array(self.index, "<u8").reshape(-1, n + 2).tobytes()
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(self.index), self.block, n, MAGIC))


class PlaneReader:
    """Reads such a file from a seekable binary file object."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        file.seek(size - FOOTER.size)
        at, n, self.block, self.planes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        file.seek(at)
        self.index = np.frombuffer(file.read(n * (self.planes + 2) * 8), "<u8").reshape(n, self.planes + 2)

    def chunk(self, k: int) -> bytes:
        start, n, *sizes = map(int, self.index[k])
        self.file.seek(start)
        raw = self.file.read(sum(sizes))
        width = n if self.planes == 4 else (n + 7) // 8
        planes, a = np.zeros((self.planes, width), np.uint8), 0
        for i, size in enumerate(sizes):
            if size:
                planes[i] = np.frombuffer(self.zip.decompress(raw[a : a + size], max_output_size=width), np.uint8)
            a += size
        if self.planes == 4:
            return np.ascontiguousarray(planes.T).tobytes()
        bits = np.unpackbits(planes, axis=1, count=n, bitorder="little").T
        return np.packbits(bits, axis=1, bitorder="little").tobytes()

    def read(self, start: int, n: int) -> bytes:
        """Ids [start, start + n), by the index."""
        k, skip, out = start // self.block, start % self.block, []
        while n > 0:
            part = self.chunk(k)[skip * 4 : (skip + n) * 4]
            out.append(part)
            n, k, skip = n - len(part) // 4, k + 1, 0
        return b"".join(out)

    def stream(self, start: int = 0) -> Iterator[bytes]:
        for k in range(start // self.block, len(self.index)):
            yield self.chunk(k)[(start % self.block) * 4 if k == start // self.block else 0 :]


def _name(path: str, part: int, attempt: int) -> str:
    return f"{path}/ids-{part:06d}-{attempt}.planes"


def _writing(folder: str, vocabulary: str, block: int, planes: str) -> Callable:
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, path = open_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        writer, out, at = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(_name(path, part, attempt))
                writer = PlaneWriter(out, block, planes)
            lengths = []
            for a in range(0, batch.num_rows, 500):
                for ids in encoder(vocabulary).encode(batch.column("text").slice(a, 500).to_pylist()):
                    ids += END_BYTES
                    writer.add(ids)
                    lengths.append(len(ids) // 4)
            n = np.array(lengths, np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), attempt)), pa.array(starts), pa.array(n)], ["doc_id", "part", "attempt", "at", "n_tokens"])
        if writer is not None:
            writer.close()
            out.close()

    return write


def write_tokens(docs: DataFrame, vocabulary: str, block: int = BLOCK, planes: str = "byte") -> tuple[str, DataFrame]:
    """The folder of the files, and (doc_id, part, attempt, at, n_tokens, start): part and attempt name the file,
    at and start are the ids before the document in its file and in all of them."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = (F.col("doc_id").asc_nulls_first(), "_h", "_row")
    placed = docs.withColumns({"_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    index = stored(placed.mapInArrow(_writing(folder, vocabulary, block, planes), "doc_id long, part int, attempt long, at long, n_tokens long"), "token-index")
    # One row a file, so the window's single partition is bounded by the number of files.
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return folder, index.join(F.broadcast(before), "part").select("doc_id", "part", "attempt", "at", "n_tokens", (F.col("at") + F.col("before")).alias("start"))


def _reading(folder: str) -> Callable:
    def read(batches):
        import pyarrow as pa

        files, path = open_uri(folder)
        now, file, stream, rest, at = None, None, iter(()), b"", 0
        for batch in batches:
            crcs = []
            for part, attempt, start, n in zip(*(batch.column(c).to_pylist() for c in ("part", "attempt", "at", "n_tokens"))):
                if part != now or start != at:
                    if file is not None:
                        file.close()
                    name = _name(path, part, attempt)
                    file = files.open_input_file(name)
                    stream, rest, now, at = PlaneReader(file, files.get_file_info(name).size).stream(start), b"", part, start
                left, crc = n * 4, 0
                while left:
                    if not rest:
                        rest = memoryview(next(stream))
                    piece = rest[:left]
                    crc = zlib.crc32(piece, crc)
                    rest = rest[len(piece) :]
                    left -= len(piece)
                at += n
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(folder: str, places: DataFrame) -> DataFrame:
    """Per document its start and number of ids and their crc32, from the files."""
    by_file = places.repartitionByRange("part", "at").sortWithinPartitions("part", "at")
    return by_file.mapInArrow(_reading(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(*write_tokens(table(spark, sf_dir, "documents"), default_vocabulary()))


QUERIES = {"op7_token_output": op7_token_output}
ORACLES: dict[str, str] = {}

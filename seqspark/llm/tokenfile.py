"""Token ids in independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each holding the ids of whole documents;
then a skippable frame with the document index; last the seek table of the
seekable zstandard format (sizes and a 32-bit XXH64 checksum of every frame).
A reader loads the tail, finds a document's frame, and decompresses that alone.

Files are written by Spark tasks over ranges of doc_id, so files in order hold
documents in ascending doc_id order.  Ranges go by bytes and rows of the table, so
files, and the index of a file, do not grow with it; a doc_id that many rows share,
or that is null, is cut further by its texts and rows.  A task writes under a name
of its own attempt and then moves the file, so a repeated task leaves one whole file.

Defined results: null and empty texts hold the end token alone; a null doc_id
sorts first; repeated rows are written as often as they occur; ties of doc_id go in
the order of their texts' first TIE_CHARS characters, then of a hash of the texts; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, save, text_blocks
from .wordids import word_ids

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_NO_ID = -(1 << 63)  # stands for a null doc_id
TIE_CHARS = 64
#: Bytes of text and documents of a file, about; a small table is cut into files of SMALL_BYTES for the sake of its tasks.
FILE_BYTES, SMALL_BYTES, FILE_DOCS = 1 << 28, 1 << 23, 1 << 20
#: Documents that the reader gives at once.
READ_DOCS = 1 << 15


class Writer:
    """Writes documents to an open binary file; frame_bytes bounds a frame unless one document is larger."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.out, self.most = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.held_bytes, self.frames, self.docs = [], 0, [], array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > self.most:
            self._flush()
        self.docs.extend((_NO_ID if doc_id is None else doc_id, len(self.frames), self.held_bytes // 4, len(ids) // 4))
        self.held.append(ids)
        self.held_bytes += len(ids)

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = np.array(self.docs, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in [*self.frames, (len(index) + 8, 0, 0)])
        footer = struct.pack("<IBI", len(self.frames) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(footer)) + table + footer)


class Reader:
    """Random access to documents of a file that has seek() and read()."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token file")
        source.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        source.seek(int(self.starts[-2]) + 8)
        self.docs = np.frombuffer(source.read(int(self.frames[-1, 0]) - 8), "<i8").reshape(-1, 4)
        self._held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash

        if self._held[0] != k:
            self.source.seek(int(self.starts[k]))
            raw = self.decompressor.decompress(self.source.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self._held = (k, raw)
        return self._held[1]

    def document(self, i: int) -> bytes:
        """Ids of the i-th document of the file, as bytes."""
        _, k, at, n = (int(x) for x in self.docs[i])
        return self.frame(k)[4 * at : 4 * (at + n)]


SHARDS = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())]
)
ROWS = T.StructType([T.StructField(c, T.LongType()) for c in ("shard", "doc_id", "start", "n_tokens", "ids_crc32")])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_bytes: int = 1 << 18) -> DataFrame:
    """Write docs (doc_id, text) as token files into folder; returns one row (shard, path, n_docs, n_ids) per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, encoder, end = task.partitionId(), word_ids(tokenizer), end_id.to_bytes(4, "little")
        blocks = text_blocks(batches, 4_000_000)
        first = next(blocks, None)
        if first is None:
            return
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        draft, path = f"{root}/.{shard}-{task.taskAttemptId()}", f"{root}/{shard:06d}.tokens"
        n = 0
        with store.open_output_stream(draft) as out:
            writer = Writer(out, frame_bytes)
            while first is not None:
                block, texts = first
                for doc, ids in zip(block.column("doc_id").to_pylist(), encoder.many(texts), strict=True):
                    n += len(ids) // 4 + 1
                    writer.add(doc, ids + end)
                first = next(blocks, None)
            writer.close()
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)
        store.move(draft, path)
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "path": f"{folder}/{shard:06d}.tokens", "n_docs": len(writer.docs) // 4, "n_ids": n}],
            pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    text = docs["text"]
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text, F.substring(text, 1, TIE_CHARS).alias("tie"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row")
    )
    n_bytes, n_rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-(n_bytes or 0) // FILE_BYTES), -(-n_rows // FILE_DOCS), min(tasks, -(-(n_bytes or 0) // SMALL_BYTES)))
    order = ["doc_id", "tie", "text_hash", "row"]
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return save(ordered.select("doc_id", "text").mapInArrow(run, SHARDS), "shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """One row per document of the files (shard, path, base): (shard, doc_id, start, n_tokens, ids_crc32); starts begin at base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, where = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(where) as source:
                    reader, start = Reader(source, source.size()), row["base"]
                    for lo in range(0, len(reader.docs), READ_DOCS):
                        ids, n = reader.docs[lo : lo + READ_DOCS, 0], reader.docs[lo : lo + READ_DOCS, 3]
                        crc = [zlib.crc32(reader.document(i)) for i in range(lo, lo + len(n))]
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(n), row["shard"])), pa.array(ids, mask=ids == _NO_ID), pa.array(starts), pa.array(n), pa.array(crc, pa.int64())],
                            names=ROWS.names,
                        )

    return shards.select("shard", "path", "base").repartition(max(1, shards.count())).mapInArrow(run, ROWS)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents, read them back: doc_id, start over all files, n_tokens, ids_crc32.

    Only the files' totals, one row per file, meet in one task to become offsets.
    """
    shards = write_tokens(docs, new_folder(spark, "tokens"), tokenizer)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    return read_tokens(shards.select("shard", "path", before.alias("base"))).select("doc_id", "start", "n_tokens", "ids_crc32")

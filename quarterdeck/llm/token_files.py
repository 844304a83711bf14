"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by ranges of their id and each task writes one file, in id order: record batches
of two fixed-size lists, ``ids`` and ``mask``, so that a memory-mapped file gives any sequence without a
copy. Only a file's last sequence is filled up; its mask says where it ends. Ids take two bytes where the
vocabulary allows. Beside each file lies another with a row per document: id, place of its first id in
the file, number of ids. A table with a row per file, written by Spark when all files are complete, says
which files count: those of tasks that were lost or run twice are not in it and are never read.

Files go to the shared folder through ``pyarrow.fs``, and are read back the same way; local ones are mapped.

Defined results: a null or empty text has the end id alone; rows of one id stand in the order of their
texts; rows without an id come first; an empty table gives no rows. Only id and text are read. A task
holds one record batch of a few thousand sequences at a time, and the ids of a block of texts, or of one longer text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm import bpe
from quarterdeck.llm.common import table
from quarterdeck.session import materialize, shared_dir

SEQUENCE = 1024
BATCH_SEQUENCES = 1024
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
FILES = "part int, path string, n_tokens long, n_docs long"


def _resolved(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def opened(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader of an Arrow file; a local file is mapped, so its batches are views of it."""
    system, name = _resolved(path)
    source = pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
    return pa.ipc.open_file(source)


def _list_array(values: pa.Array, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(values, length)


class SequenceWriter:
    """Writes a stream of ids as sequences of one length."""

    def __init__(self, path: str, length: int, dtype: np.dtype) -> None:
        self.length, self.dtype, self.rest, self.n = length, dtype, [], 0
        self.schema = pa.schema([
            pa.field("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
            pa.field("mask", pa.list_(pa.bool_(), length)),
        ])
        system, name = _resolved(path)
        self.sink = system.open_output_stream(name)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting = 0

    def add(self, ids: np.ndarray) -> int:
        """Append ids; returns where they start."""
        start = self.n
        self.rest.append(ids.astype(self.dtype))
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH_SEQUENCES * self.length:
            self._write(full=False)
        return start

    def _write(self, full: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, self.dtype)
        step = BATCH_SEQUENCES * self.length
        whole = len(ids) if full else len(ids) - len(ids) % step
        for at in range(0, whole, step):
            part = ids[at : min(at + step, whole)]
            padded = -(-len(part) // self.length) * self.length
            mask = np.arange(padded) < len(part)
            self.file.write_batch(pa.RecordBatch.from_arrays([
                _list_array(pa.array(np.pad(part, (0, padded - len(part)))), self.length),
                _list_array(pa.array(mask), self.length),
            ], schema=self.schema))
        self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._write(full=True)
        self.file.close()
        self.sink.close()


class SequenceFile:
    """Random access to a file of sequences."""

    def __init__(self, path: str) -> None:
        self.reader = opened(path)
        self.batches = self.reader.num_record_batches

    def batch(self, i: int) -> np.ndarray:
        """Ids of a record batch, end to end, without its filling; a view of the file where it is mapped."""
        b = self.reader.get_batch(i)
        ids = b.column("ids").flatten().to_numpy(zero_copy_only=True)
        return ids if i + 1 < self.batches else ids[: int(b.column("mask").flatten().true_count)]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of one sequence, as views."""
        b = self.reader.get_batch(i // BATCH_SEQUENCES)
        row = i % BATCH_SEQUENCES
        return b.column("ids")[row].values.to_numpy(zero_copy_only=True), b.column("mask")[row].values

    def spans(self, spans: Iterator[tuple[int, int]]) -> Iterator[np.ndarray]:
        """Ids of spans (start, length) in ascending order of start."""
        size, at, held = None, -1, np.zeros(0)
        for start, n in spans:
            out = []
            while n:
                if size is None:
                    size = len(self.batch(0)) if self.batches > 1 else 1 << 62
                if start // size != at:
                    at = start // size
                    held = self.batch(at)
                part = held[start - at * size : start - at * size + n]
                out.append(part)
                start, n = start + len(part), n - len(part)
            yield np.concatenate(out) if len(out) != 1 else out[0]


def _write(folder: str, length: int, tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        system, name = _resolved(folder)
        writer, index = None, None
        docs = 0
        for batch in batches:
            for at, ids, bounds in bpe.encoded(batch.column("text"), tokenizer):
                if writer is None:
                    system.create_dir(name, recursive=True)
                    size = bpe.encoder(tokenizer).library.get_vocab_size()
                    writer = SequenceWriter(f"{path}.arrow", length, np.dtype("<u2" if size <= 1 << 16 else "<u4"))
                    sink = _resolved(f"{path}.index.arrow")
                    stream = sink[0].open_output_stream(sink[1])
                    index = pa.ipc.new_file(stream, INDEX)
                starts, n = writer.add(ids) + bounds[:-1], len(bounds) - 1
                index.write_batch(pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, n), pa.array(starts, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                ], schema=INDEX))
                docs += n
        if writer is not None:
            writer.close()
            index.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([path]), pa.array([writer.n], pa.int64()), pa.array([docs], pa.int64()),
            ], names=["part", "path", "n_tokens", "n_docs"])

    return run


def write_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
    length: int = SEQUENCE, tokenizer: str = bpe.TOKENIZER,
) -> DataFrame:
    """Write the files; a row per file in the order of their ids: part, path, n_tokens, n_docs, start."""
    folder = folder or shared_dir(docs.sparkSession)
    ordered = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(ordered.mapInArrow(_write(folder, length, tokenizer), FILES))
    # One row per file; the sum over them is the only thing that needs all files together.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return materialize(files.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            index, ids = opened(f"{row['path']}.index.arrow"), SequenceFile(f"{row['path']}.arrow")

            def places(index=index) -> Iterator[tuple[int, int]]:
                for i in range(index.num_record_batches):
                    b = index.get_batch(i)
                    yield from zip(b.column("start").to_pylist(), b.column("n_tokens").to_pylist())

            values = ids.spans(places())
            for i in range(index.num_record_batches):
                b = index.get_batch(i)
                crc = [bpe.crc32(next(values)) for _ in range(b.num_rows)]
                starts = b.column("start").to_numpy() + row["start"]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(starts), b.column("n_tokens"), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_tokens(files: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start among all ids, n_tokens, ids_crc32."""
    # A task per file; without a number, adaptive execution would put the few bytes of this table into one task.
    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))

"""Packing documents into sequences by minimum bin slack.

A document's ids are cut into pieces of at most ``CAPACITY`` ids; the first piece takes what is left over.
Which pieces go together depends on their lengths alone, so the plan is made from the number of pieces of
each length: at most ``CAPACITY`` numbers, whatever the size of the table. Per sequence the longest piece
left is taken, and subset sums over the lengths still available, kept as bits of one integer, give the
fullest combination that fits beside it. That combination is used for as many sequences as its pieces last
and removed; then the next is sought. Each step uses up a length of its pattern, so there are at most a
few thousand patterns.

Pieces find their places without a shuffle by length: each task counts its pieces of a length while it
encodes, sums over tasks give every piece its rank among those of its length, and the rank tells pattern,
sequence and place. A length that a third of all pieces share is spread like any other. The plan is looked
up in the tasks; it has a row per pattern and length.

Defined results: a null or empty text is one piece with the end id alone; repeated rows and rows without
an id are packed like any other; an empty table gives no rows. Only id and text are read. Texts are
encoded whole, a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm import bpe
from quarterdeck.llm.common import table
from quarterdeck.session import materialize

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, seen long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def _pieces(capacity: int, tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, ids, bounds in bpe.encoded(batch.column("text"), tokenizer):
                out: list[tuple] = []
                begins = bounds.tolist()
                for doc, begin, end in zip(batch.column("doc_id").slice(at, len(begins) - 1).to_pylist(), begins, begins[1:]):
                    for k, (start, length) in enumerate(cuts(end - begin, capacity)):
                        crc = bpe.crc32(ids[begin + start : begin + start + length])
                        out.append((doc, k, start, length, crc, task, int(seen[length])))
                        seen[length] += 1
                doc, *rest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), *(pa.array(c, t) for c, t in zip(rest, (
                        pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "seen"],
                )

    return run


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences from number ``first`` on, each holding ``lengths`` in this order."""

    first: int
    times: int
    lengths: tuple[int, ...]


def fullest(room: int, counts: np.ndarray) -> list[int]:
    """Available lengths, longest first, whose sum is the largest that fits ``room``.

    Bit s of the integer ``sums`` says whether the lengths looked at so far can add up to s.
    """
    if room <= 0:
        return []
    mask, sums, trail = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1]).tolist():
        left, chunk = min(int(counts[length]), room // length), 1
        while left:  # a count as a sum of powers of two, so that few shifts cover it
            take = min(chunk, left)
            trail.append((length, take, sums))
            sums |= sums << (length * take) & mask
            left, chunk = left - take, chunk * 2
        if sums >> room & 1:
            break
    total, out = sums.bit_length() - 1, []
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            out.extend([length] * take)
            total -= length * take
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """The sequences for so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns, number = [], 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        lengths = [longest, *fullest(capacity - longest, left)]
        left[longest] += 1
        used = np.bincount(lengths, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        patterns.append(Pattern(number, times, tuple(sorted(lengths, reverse=True))))
        number += times
    return patterns


@dataclass(frozen=True)
class Places:
    """The plan as arrays, a row per pattern and length, sorted by length and first rank."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given by length and rank among those of their length."""
        at = np.empty(len(length), np.int64)
        for value in np.unique(length):
            mine = length == value
            low, high = np.searchsorted(self.length, [value, value + 1])
            at[mine] = low + np.searchsorted(self.rank[low:high], rank[mine], side="right") - 1
        inside = rank - self.rank[at]
        return self.first[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def places(patterns: list[Pattern], capacity: int = CAPACITY) -> Places:
    given, rows = np.zeros(capacity + 1, np.int64), []
    for p in patterns:
        offset = 0
        for length in sorted(set(p.lengths), reverse=True):
            each = p.lengths.count(length)
            rows.append((length, given[length], each, p.first, offset))
            given[length] += each * p.times
            offset += each * length
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return Places(*columns[np.lexsort((columns[:, 1], columns[:, 0]))].T)


def _placed(found: Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            sequence, offset = found.find(length, rank)
            kept = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = bpe.TOKENIZER,
) -> DataFrame:
    """A row per piece: its span of the document's ids, their crc, and its sequence and place there."""
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = materialize(read.mapInArrow(_pieces(capacity, tokenizer), PIECES))
    per_task = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = materialize(per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("seen") + F.col("before"))
    return ranked.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "rank"
    ).mapInArrow(
        _placed(places(plan(counts, capacity), capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Packing documents into fixed windows by non-negative least squares over a histogram of lengths.

A document's ids are cut into whole windows, a body of a multiple of ``UNIT`` ids and a tail of fewer than
``UNIT``; ``windows`` over ``UNIT`` body lengths and ``UNIT`` tail lengths are all there are. All combinations
of up to ``DEPTH`` body lengths that fill a window are enumerated, and non-negative least squares finds how
often to repeat each so that together they use up the histogram of bodies. The repeats are rounded, limited
to the bodies there are, and what is left over, bodies and all tails, is packed greedily: the longest piece
left, then the fullest combination beside it. As tails are of all lengths below a unit, such windows come
out full. Only the last one or few do not: their pieces are dealt out to sequences of a power of two, which need no
padding, as far as sums allow.

The plan is made from the number of pieces of each length, so the driver gets as many numbers as there are
lengths, whatever the size of the table. Pieces find their places without a shuffle by length: a task counts
its pieces of a length while it encodes, sums over tasks give each piece its rank, and the rank tells pattern,
sequence and place; a length that a third of all pieces share is spread like any other.

Defined results: a null or empty text is one piece with the end id alone; repeated rows and rows without an
id are packed like any other; an empty table gives no rows. Only id and text are read; other columns, whatever
their names, are not. Texts are encoded whole, a few hundred at a time; ids must fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm import bpe, packing
from quarterdeck.llm.common import SLICE_ROWS, table
from quarterdeck.llm.word_bpe import word_encoder
from quarterdeck.session import materialize

WINDOW = 4096
UNIT = 64
DEPTH = 4
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("task", pa.int32()), ("seen", pa.int64()),
])


def cuts(n: int, window: int = WINDOW, unit: int = UNIT) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: whole windows, a body, a tail."""
    whole, body = n - n % window, n - n % unit
    rest = [(whole, body - whole), (body, n - body)]
    return [(s, window) for s in range(0, whole, window)] + [(s, k) for s, k in rest if k]


def combinations(total: int, depth: int, largest: int | None = None) -> list[tuple[int, ...]]:
    """All ways to write ``total`` as a sum of up to ``depth`` positive numbers, each falling or equal."""
    largest = min(total, largest or total)
    out: list[tuple[int, ...]] = [(total,)] if total <= largest else []
    if depth > 1:
        for first in range(min(largest, total - 1), 0, -1):
            if first * depth < total:
                break
            out.extend((first, *rest) for rest in combinations(total - first, depth - 1, first))
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ||a x - b||, by active sets (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    enough = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(10 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if not len(slope) or slope.max() <= enough:
            break
        active[slope.argmax()] = True
        while True:
            some = np.flatnonzero(active)
            best = np.linalg.lstsq(a[:, some], b, rcond=None)[0]
            if best.min(initial=1) > 0:
                x[:] = 0
                x[some] = best
                break
            # Back to where the first of them reaches zero.
            down = best <= 0
            at = x[some][down]
            step = (at / np.maximum(at - best[down], 1e-300)).min()
            x[some] += step * (best - x[some])
            gone = some[(x[some] <= 1e-12 * max(1.0, x.max())) & (best <= 0)]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
    return x


def _solved(left: np.ndarray, window: int, unit: int, depth: int) -> list[tuple[int, tuple[int, ...]]]:
    """Repeats of combinations of bodies, limited to the bodies that are ``left``, which is reduced by them."""
    n = window // unit
    have = left[unit:window:unit]
    combos = [c for c in combinations(n, depth, n - 1) if all(have[k - 1] for k in c)]
    if not combos:
        return []
    uses = np.zeros((n - 1, len(combos)))
    for i, c in enumerate(combos):
        np.add.at(uses[:, i], np.array(c) - 1, 1)
    x = non_negative_least_squares(uses, have.astype(float))
    out = []
    for i in np.argsort(-x, kind="stable").tolist():
        need = uses[:, i].astype(np.int64)
        some = need > 0
        times = min(int(np.floor(x[i] + 0.5)), int((have[some] // need[some]).min()))
        if times > 0:
            have -= times * need  # a view of ``left``
            out.append((times, tuple(unit * k for k in combos[i])))
    return out


def _powers(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """The pieces of windows that are not full, in sequences whose sums are powers of two as far as may be."""
    pool = np.bincount(lengths, minlength=window + 1)
    out: list[tuple[int, ...]] = []
    size = 1 << (window.bit_length() - 1)
    while size:
        some = packing.fullest(size, pool) if pool.any() else []
        if sum(some) == size:
            pool -= np.bincount(some, minlength=len(pool))
            out.append(tuple(some))
        else:
            size //= 2
    counts = {int(k): int(pool[k]) for k in np.flatnonzero(pool)}
    for p in packing.plan(counts, window):
        out.extend([p.lengths] * p.times)
    return out


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def plan(
    counts: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH,
) -> list[packing.Pattern]:
    """The sequences for so many pieces of each length."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    found = [(int(left[window]), (window,))] if left[window] else []
    left[window] = 0
    found += _solved(left, window, unit, depth)
    loose: list[int] = []
    for p in packing.plan({int(k): int(left[k]) for k in np.flatnonzero(left)}, window):
        if padding(sum(p.lengths), window):
            loose.extend(p.lengths * p.times)
        else:
            found.append((p.times, p.lengths))
    apart = _powers(loose, window)
    if sum(padding(sum(c), window) for c in apart) <= padding(sum(loose), window) or sum(loose) > window:
        found += [(1, c) for c in apart]
    else:
        found.append((1, tuple(sorted(loose, reverse=True))))
    patterns, number = [], 0
    for times, lengths in found:
        patterns.append(packing.Pattern(number, times, lengths))
        number += times
    return patterns


def _pieces(window: int, unit: int, tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        encode, end = word_encoder(tokenizer).encode, np.uint32(END_ID).astype("<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                out: list[tuple] = []
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    ids = np.frombuffer(encode(text) + end, dtype="<u4")
                    for start, length in cuts(len(ids), window, unit):
                        crc = bpe.crc32(ids[start : start + length])
                        out.append((doc, start, length, crc, len(ids), task, int(seen[length])))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)

    return run


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed(found: packing.Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            sequence, offset = found.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*map(b.column, kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, unit: int = UNIT,
    depth: int = DEPTH, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """A row per piece: its span of the document's ids, their crc, and its sequence and place there.

    ``window`` and ``unit`` are powers of two.
    """
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = materialize(read.mapInArrow(
        _pieces(window, unit, tokenizer),
        "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, seen long",
    ))
    per_task = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    # A number per length: at most twice ``unit`` of them with the default settings.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = materialize(per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")))
    ranked = pieces.join(offsets, ["task", "length"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("seen") + F.col("before")).alias("rank"),
    )
    return ranked.mapInArrow(_placed(packing.places(plan(counts, window, unit, depth), window)), PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

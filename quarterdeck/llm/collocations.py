"""Phrase collocations from depth-truncated suffix subtrees, built in groups of word prefixes.

Words follow each other within a piece of text; from every word on, the next ``DEPTH`` words are a suffix.
The suffixes are divided by their first words (vertical partitioning): a first word with more than a
``SPLIT``-th of the budget of occurrences is extended by the second, such a pair by the third, and so on, and
prefixes are dealt out by hash to so many groups that a group holds half of ``BUDGET`` occurrences on average. Each
group sorts its suffixes, which is its part of the suffix tree: a node is a run of leaves that begin alike,
and its count the sum of their totals. A node above the extended prefixes is spread over groups; its parts
are added up.

A phrase is a candidate only if it occurs ``LEAST`` times, and then so do its parts. A suffix therefore ends
where the phrase up to there is too rare, and is left out if its first pair is. Words are counted exactly
for that. Of phrases of two words and more, hashes are counted in cells (up to ``CELLS`` for each length, a fixed bound), and cells
with fewer than ``LEAST`` hold no candidate; the tasks get a bit per cell. A cell that rare phrases share may
let them through, which costs time and never changes a count; the same holds for cells of frequent prefixes.
Every place gives a row at most; equal suffixes are added up by Spark, in each task before they are sent and over all
tasks before they are grouped, so that a group gets each of its suffixes once, however often it occurs.

A candidate is cut after every word; both parts have counts of their own, joined by phrase. The score is
whole-number division of decimals, exact beyond 64 bits. Candidates that lie in a longer one of nearly their
count go: each candidate tells its parts its count, and the largest is kept per part. Of each language the
best are taken from the best of ``SALTS`` parts.

Defined results: null texts are empty, a null language is ``und``; empty texts and pieces have no words;
repeated rows count each time; ties go to the smaller cut, and to the phrase of smaller bytes. Empty tables
give no rows. Only text and language are read; a word may be as long as its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm.common import SLICE_ROWS, table
from quarterdeck.session import materialize

DEPTH = 4
LEAST = 30
WITHIN = 80
BEST = 2000
FACTOR = 2_000_000
UNKNOWN = "und"
#: Suffixes of a group, counted as often as they occur.
BUDGET = 1 << 20
SPLIT = 16
#: Bits of the set of frequent words, and most cells for the phrases of a length.
BITS = 1 << 25
CELLS = 1 << 26
CHUNK = 1 << 16
#: Distinct words and numbers a task holds before it sends them on.
HELD = 200_000
HELD_NUMBERS = 1 << 20
#: Bytes of text, and of words or suffixes, that are looked at together; the second is a multiple of the number of weights.
BLOCK = 1 << 22
HASHED = 1 << 20
#: Of the bytes of a word, in turn.
WEIGHTS = np.random.default_rng(42).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = 32
SEED = 42

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower case, a line feed for every character that ends a piece, a space for a tab.
PLAIN = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
SPACES = re.compile(b" {2,}")


def plain(text: str | None) -> bytes:
    """Words with one space between them, and a line feed where a piece ends."""
    return SPACES.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(PLAIN))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """A language and texts in it, together; a longer text is a block of its own."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            rows = batch.slice(at, SLICE_ROWS)
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                held.setdefault(lang, []).append(plain(text))
                size += len(held[lang][-1])
                if size >= BLOCK:
                    yield from ((g, b"\n".join(texts)) for g, texts in held.items())
                    held, size = {}, 0
    yield from ((g, b"\n".join(texts)) for g, texts in held.items())


class Words:
    """Where the words of a block are, their hashes, and how far they run on within their piece."""

    def __init__(self, lang: str, block: bytes) -> None:
        data = np.frombuffer(block, np.uint8)
        ends = np.append(np.flatnonzero((data == 32) | (data == 10)), len(data))
        starts = np.append(0, ends[:-1] + 1)
        real = ends > starts
        # Whether a piece ends between a word and the one before it.
        breaks = np.cumsum(np.append(0, data[ends[:-1]] == 10))[real]
        self.starts, self.ends = starts[real], ends[real]
        self.piece = breaks
        self.data = data
        self.numbers = word_hashes(lang, data, self.starts, self.ends)

    def phrases(self, n: np.ndarray, at: np.ndarray) -> Iterator[tuple[slice, pa.Array]]:
        """The ``n`` words from each of the given places on; about ``HASHED`` bytes of them at a time."""
        starts, sizes = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        after, first = np.cumsum(sizes), 0
        while first < len(at):
            sent = int(after[first] - sizes[first])
            to = max(first + 1, int(np.searchsorted(after, sent + HASHED, side="right")))
            offsets = np.append(0, after[first:to] - sent)
            if to == first + 1:
                flat = self.data[starts[first] : starts[first] + sizes[first]]
            else:
                flat = self.data[np.repeat(starts[first:to] - offsets[:-1], sizes[first:to]) + np.arange(offsets[-1])]
            buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)]
            yield slice(first, to), pa.Array.from_buffers(pa.binary(), to - first, buffers)
            first = to

    def pairs(self) -> np.ndarray:
        """Whether the next word is of the same piece."""
        return self.piece[1:] == self.piece[:-1]


def word_hashes(lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word and the language, never 0; a bounded number of bytes at a time."""
    lengths = ends - starts
    after = np.cumsum(lengths)
    before = after - lengths
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(after, before[at] + HASHED, side="right")))
        if to == at + 1:
            for first in range(int(starts[at]), int(ends[at]), HASHED):
                part = data[first : min(first + HASHED, int(ends[at]))].astype(np.uint64) + np.uint64(1)
                out[at] += (part * np.resize(WEIGHTS, len(part))).sum(dtype=np.uint64)
        else:
            size, offsets = lengths[at:to], before[at:to] - before[at]
            place = np.arange(int(size.sum())) - np.repeat(offsets, size)
            part = data[place + np.repeat(starts[at:to], size)].astype(np.uint64) + np.uint64(1)
            out[at:to] = np.add.reduceat(part * WEIGHTS[place % len(WEIGHTS)], offsets)
        at = to
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), SEED))
    out = followed(out ^ seed, lengths.astype(np.uint64))
    return np.maximum(out, np.uint64(1))


def followed(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase followed by a word."""
    mixed = (phrase * np.uint64(0x9E3779B97F4A7C15) + word) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(32))


def in_set(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set; there are a power of two of them."""
    word = (numbers >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[word.astype(np.int64)] >> (numbers & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_set(words: DataFrame) -> np.ndarray:
    """The bits of the column ``number``: ``BITS`` / 64 longs at most."""
    bits = words.select(F.col("number").bitwiseAND(F.lit(BITS - 1)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    ).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_hashes(numbers: np.ndarray) -> list[np.ndarray]:
    """Of the phrases of 1 to ``DEPTH`` words from each place on."""
    out = [numbers]
    for n in range(1, DEPTH):
        out.append(followed(out[-1][:-1], numbers[n:]) if len(out[-1]) else out[-1])
    return out


CELL_COUNTS = pa.schema([("words", pa.int32()), ("chunk", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
CELL_BITS = pa.schema([("words", pa.int32()), ("chunk", pa.int32()), ("often", pa.binary()), ("long", pa.binary())])
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])
WORDS = pa.schema([*COUNTS, ("number", pa.int64())])
SUFFIXES = pa.schema([("group", pa.int64()), ("lang", pa.string()), ("suffix", pa.binary())])


def _counted(
    each: Callable[[str, bytes], Iterable[bytes]], send: Callable[[str, Counter], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of what ``each`` finds in a block, sent on whenever many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for lang, block in blocks(batches):
            counts.setdefault(lang, Counter()).update(each(lang, block))
            if sum(map(len, counts.values())) >= HELD:
                yield from (send(lang, held) for lang, held in counts.items() if held)
                counts = {}
        yield from (send(lang, held) for lang, held in counts.items() if held)

    return run


def _as_words(lang: str, held: Counter) -> pa.RecordBatch:
    words = list(held)
    numbers = Words(lang, b"\n".join(words)).numbers.view(np.int64)
    columns = [pa.array([lang] * len(words)), pa.array(words, pa.binary()), pa.array(list(held.values()), pa.int64()), pa.array(numbers)]
    return pa.RecordBatch.from_arrays(columns, schema=WORDS)


def _words(lang: str, block: bytes) -> list[bytes]:
    return block.split()


def _cells(often: np.ndarray, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many phrases of frequent words fall into each cell, in chunks of cells."""
    def send(n: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, counts = np.unique(np.concatenate(held) & np.uint64(cells - 1), return_counts=True)
        chunk, at = (at // CHUNK).astype(np.int32), (at % CHUNK).astype("<u2")
        starts = np.flatnonzero(np.diff(chunk, prepend=-1))
        ends = [*starts[1:].tolist(), len(at)]
        pairs = list(zip(starts.tolist(), ends))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(starts), n, np.int32)), pa.array(chunk[starts]),
            pa.array([at[a:b].tobytes() for a, b in pairs], pa.binary()),
            pa.array([counts[a:b].astype("<u4").tobytes() for a, b in pairs], pa.binary()),
        ], schema=CELL_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {n: [] for n in range(2, DEPTH + 1)}
        for lang, block in blocks(batches):
            words = Words(lang, block)
            fits, pairs = in_set(often, words.numbers), words.pairs()
            for n, phrases in enumerate(phrase_hashes(words.numbers)[1:], 2):
                # Both parts of one word less are in a piece and of frequent words.
                fits = fits[:-1] & fits[1:] & pairs[: len(phrases)]
                held[n].append(phrases[fits])
                if sum(map(len, held[n])) >= HELD_NUMBERS:
                    yield from send(n, held[n])
                    held[n] = []
        for n, some in held.items():
            if sum(map(len, some)):
                yield from send(n, some)

    return run


def _merged(least: int, many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bits of the cells with ``least`` phrases at all, and of those with more than ``many``; rows come by chunk."""

    def bits(key: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
        sets = (np.packbits(x, bitorder="little").tobytes() for x in (sums >= least, sums > many))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *sets), CELL_BITS)], schema=CELL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros(CHUNK, np.int64)
        for batch in batches:
            for words, chunk, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (words, chunk) != key:
                    if key:
                        yield bits(key, sums)
                    key, sums = (words, chunk), np.zeros(CHUNK, np.int64)
                sums[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<u4")
        if key:
            yield bits(key, sums)

    return run


def _cell_bits(read: DataFrame, often: np.ndarray, cells: int, least: int, many: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By number of words less two: the bits of cells that may hold a candidate, and of those with long prefixes."""
    counts = read.mapInArrow(_cells(often, cells), "words int, chunk int, cells binary, counts binary")
    chunks = counts.repartition("words", "chunk").sortWithinPartitions("words", "chunk").mapInArrow(
        _merged(least, many), "words int, chunk int, often binary, long binary"
    )
    sets = tuple([np.zeros(cells // 64, np.uint64) for _ in range(2, DEPTH + 1)] for _ in range(2))
    size = min(CHUNK, cells) // 64
    # Two bits a cell, of a bounded number of cells.
    for row in chunks.toArrow().to_pylist():
        for out, name in zip(sets, ("often", "long")):
            at = row["chunk"] * CHUNK // 64
            out[row["words"] - 2][at : at + size] = np.frombuffer(row[name], "<u8")[:size]
    return sets


def _suffixes(
    often: np.ndarray, candidates: list[np.ndarray], long: list[np.ndarray], groups: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From every place the longest phrase all of whose parts may be frequent, in the group of its prefix.

    ``long`` has the bits of the prefixes of one word and more that are extended.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks(batches):
            words = Words(lang, block)
            hashes = phrase_hashes(words.numbers)
            fits, pairs = in_set(often, words.numbers), words.pairs()
            length = fits.astype(np.int8)
            for n, (phrases, bits) in enumerate(zip(hashes[1:], candidates), 2):
                fits = fits[:-1] & fits[1:] & pairs[: len(phrases)] & in_set(bits, phrases)
                length[: len(fits)][fits] = n
            at = np.flatnonzero(length > 1)
            length = length[at]
            prefix, open_ = words.numbers[at], np.ones(len(at), bool)
            for n, phrases in enumerate(hashes[1:], 1):
                open_ &= in_set(long[n - 1], prefix) & (length > n)
                prefix[open_] = phrases[at[open_]]
            group = (prefix % np.uint64(groups)).astype(np.int64)
            for part, suffixes in words.phrases(length, at):
                langs = pa.repeat(pa.scalar(lang, pa.string()), len(suffixes))
                yield pa.RecordBatch.from_arrays([pa.array(group[part]), langs, suffixes], schema=SUFFIXES)

    return run


def subtree(rows: pa.Table) -> pa.Table:
    """The nodes of the suffixes of a group: ``lang``, ``phrase`` of two words or more, and its count here."""
    rows = rows.group_by(["lang", "suffix"]).aggregate([("n", "sum")])
    lang = pc.dictionary_encode(rows.column("lang")).combine_chunks()
    words = pc.split_pattern(rows.column("suffix"), b" ").combine_chunks()
    flat, offsets = pc.dictionary_encode(words.flatten()), words.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    leaves = np.full((len(sizes), DEPTH), -1, np.int32)
    leaves[np.arange(DEPTH) < sizes[:, None]] = flat.indices.to_numpy()
    langs = lang.indices.to_numpy()
    order = np.lexsort((*leaves.T[::-1], langs))
    leaves, langs, totals = leaves[order], langs[order], rows.column("n_sum").to_numpy()[order]
    spelling, names = flat.dictionary.to_pylist(), lang.dictionary.to_pylist()
    change, out = np.ones(len(leaves), bool), []
    change[1:] = langs[1:] != langs[:-1]
    for depth in range(DEPTH):
        change[1:] |= leaves[1:, depth] != leaves[:-1, depth]
        starts = np.flatnonzero(change)
        if not depth or not len(starts):
            continue
        counts = np.add.reduceat(totals, starts)
        real = leaves[starts, depth] >= 0
        for at, n in zip(starts[real].tolist(), counts[real].tolist()):
            out.append((names[langs[at]], b" ".join([spelling[w] for w in leaves[at, : depth + 1].tolist()]), n))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], [], []), COUNTS)], schema=COUNTS)


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, budget: int = BUDGET,
) -> DataFrame:
    """``lang``, ``phrase`` (words joined by spaces), ``words`` and count ``f`` of all words, and of the phrases
    of up to ``DEPTH`` words that occur ``least`` times."""
    read = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = "lang string, phrase binary, n long"
    words = materialize(
        read.mapInArrow(_counted(_words, _as_words), f"{counted}, number long").groupBy("lang", "phrase", "number").agg(F.sum("n").alias("n"))
    )
    frequent = words.filter(F.col("n") >= least)
    often = bit_set(frequent)
    total = frequent.agg(F.sum("n")).first()[0] or 0
    many = budget // SPLIT
    cells = min(CELLS, max(CHUNK, 1 << total.bit_length()))
    candidates, long = _cell_bits(read, often, cells, least, many)
    long = [bit_set(frequent.filter(F.col("n") > many)), *long]
    groups = max(1, -(-2 * total // budget))
    suffixes = read.mapInArrow(_suffixes(often, candidates, long, groups), "group long, lang string, suffix binary")
    # Equal suffixes are added up in each task, and over all tasks before they come to a group.
    leaves = suffixes.groupBy("group", "lang", "suffix").agg(F.count(F.lit(1)).alias("n"))
    nodes = leaves.groupBy("group").applyInArrow(lambda rows: subtree(rows.select(["lang", "suffix", "n"])), counted)
    phrases = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    named = words.drop("number").unionByName(phrases).withColumn("phrase", F.col("phrase").cast("string"))
    return named.select("lang", "phrase", (F.size(F.split("phrase", " "))).alias("words"), F.col("n").alias("f"))


def _part(words: Column, first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, F.lit(first) if isinstance(first, int) else first, F.lit(length) if isinstance(length, int) else length), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, within: int = WITHIN, best: int = BEST,
    budget: int = BUDGET,
) -> DataFrame:
    """The ``best`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``."""
    counts = materialize(phrase_counts(docs, text, lang, least, budget))
    totals = counts.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = counts.filter(F.col("words").between(2, DEPTH)).select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    # Every part of a candidate occurs as often at least, so rarer words need not be joined.
    known = counts.filter(F.col("f") >= least).select("lang", F.col("phrase").alias("part"), "f")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", _part(parts, 1, F.col("k")).alias("left"), _part(parts, F.col("k") + 1, F.col("words")).alias("right"),
    )
    scored = (
        cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", F.expr(f"(CAST({FACTOR} AS DECIMAL(18)) * CAST(a AS DECIMAL(19))) DIV (CAST(l AS DECIMAL(19)) + CAST(r AS DECIMAL(19)))"))
    )
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    # Each candidate's shorter parts of two words or more.
    inner = candidates.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inner.select("lang", _part(parts, F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer")
    )
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer").cast("decimal(20)") < within * F.col("cut.a").cast("decimal(20)"), F.lit(True))
    ).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))
    first = kept.withColumn("place", some).filter(F.col("place") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    # A row per language on the right.
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
g AS (
    SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, {DEPTH + 1}) t(m))
),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING words = 1 OR f >= {LEAST}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS MATERIALIZED (
    SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words >= 2
),
e AS MATERIALIZED (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS part, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, words)) AS k FROM c)
),
k AS (
    SELECT e.lang, e.phrase, e.a, k, l.f AS l, r.f AS r, ({FACTOR}::HUGEINT * e.a) // (l.f + r.f) AS score
    FROM e JOIN f l ON l.lang = e.lang AND l.phrase = e.part JOIN f r ON r.lang = e.lang AND r.phrase = e.rest
),
s AS (SELECT lang, phrase, a, l, r, score::BIGINT AS score FROM k
      QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
    SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, m, unnest(range(1, words - m + 2)) AS b FROM c, range(2, {DEPTH}) t(m) WHERE m < words) GROUP BY ALL
),
r AS (
    SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM s LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {WITHIN} * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= {BEST}"""

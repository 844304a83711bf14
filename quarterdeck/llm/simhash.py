"""Near-duplicates by SimHash, linked through the anchors of a covering code.

Fingerprints: texts in lower-case ASCII letters, words between ASCII white space, shingles of ``size``
words (repeats count), a bit is set if it is set in more than half of the shingles' XXH64 values.

Links, for fingerprints that differ in at most four bits: the 64 bits are cut into three parts of 22, 21
and 21 bits, and two such fingerprints differ in at most one bit of one part at least. The anchors of a
part are the words of a code made of the Hamming code on its first 15 bits and all values of the other
bits. Its covering radius is one: every part value has a home anchor at most one bit away. A fingerprint
lives at its home anchor and visits every anchor within radius plus threshold, two bits, so that a linked
pair always meets at the home of either. Only distinct fingerprints take part, so exact copies cost one row.

Homes and visitors of an anchor are compared as blocks of numpy words, and only a spanning forest of the
links found there is returned: as many rows as fingerprints, not as pairs. Anchors with more than
``HOME_ROWS`` homes are dealt out in blocks of that size, and their visitors go to each block; visitors are
read in slices. So a task's memory does not depend on the largest group.

Components: alternating large-star and small-star rounds on the forest, each written to the shared folder.

Defined results: a null or empty text, or one of white space alone, has no shingle and fingerprint zero,
linked like any other; a text of fewer words than a shingle is one shingle; repeated rows share their
fingerprint; rows with a null id get the smallest id of their component, null if there is none. Ids need
not be unique. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.common import boxed, by_slices, table, unboxed
from quarterdeck.session import materialize

SEED = 42
THRESHOLD = 4
#: First bit and number of bits of each part.
PARTS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15
HOME_ROWS = 4096
VISITOR_ROWS = 16384
#: Rows of homes times visitors compared at a time.
TILE = 1 << 22


def _digests(text: str | None, size: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return [digest(view[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprints_of(texts: list[str | None], size: int = 4) -> np.ndarray:
    """The fingerprints of some texts, as unsigned 64-bit words."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        digests = np.array(_digests(text, size), dtype=np.uint64)
        if len(digests):
            counts = np.zeros(64, np.int64)
            for start in range(0, len(digests), 1 << 15):
                part = digests[start : start + (1 << 15)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * counts > len(digests), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: Column, size: int = 4) -> Column:
    """A text's fingerprint as a long with the same bits."""
    run = by_slices(lambda texts: fingerprints_of(texts, size).view(np.int64))

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array(run(column), pa.int64())

    return simhash(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _syndrome(value: Column) -> Column:
    """Of the Hamming code whose bit i stands at position i + 1; zero for code words."""
    out = F.lit(0).cast("long")
    for i in range(CODE_BITS):
        out = out.bitwiseXOR(F.shiftright(value, i).bitwiseAND(F.lit(1)) * F.lit(i + 1))
    return out.cast("int")


def _flips(bits: int) -> list[list[int]]:
    """By syndrome: all masks of at most two bits that lead from such a value to a code word."""
    syndrome = [i + 1 if i < CODE_BITS else 0 for i in range(bits)]
    out: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    out[0].append(0)
    for i in range(bits):
        out[syndrome[i]].append(1 << i)
        for j in range(i):
            out[syndrome[i] ^ syndrome[j]].append(1 << i | 1 << j)
    return out


def _flip(part: int, value: Column):
    return lambda mask: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(mask).alias("anchor"))


def _homes_and_visits(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct fingerprint with its home anchors, and with all anchors in reach: part, anchor, fp."""
    homes, visits = [], []
    for k, (first, bits) in enumerate(PARTS):
        value = _part(F.col("fp"), first, bits)
        syndrome = _syndrome(value)
        nearest = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << i for i in range(CODE_BITS)))])
        home = value.bitwiseXOR(F.get(nearest, syndrome))
        homes.append(F.struct(F.lit(k).alias("part"), home.alias("anchor")))
        table_of_flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _flips(bits)])
        visits.append(F.transform(F.get(table_of_flips, syndrome), _flip(k, value)))
    at = [F.col("at.part").alias("part"), F.col("at.anchor").alias("anchor"), "fp"]
    return (
        fps.select("fp", F.explode(F.array(*homes)).alias("at")).select(*at),
        fps.select("fp", F.explode(F.concat(*visits)).alias("at")).select(*at),
    )


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def forest(homes: np.ndarray, visitors: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """Links that join homes and visitors as far as all links of at most four bits would.

    ``parent`` holds which homes are joined already; it is kept up to date between slices of visitors.
    """
    out: list[tuple[int, int]] = []
    step = max(1, TILE // max(1, len(homes)))
    for start in range(0, len(visitors), step):
        block = visitors[start : start + step]
        near = np.bitwise_count(block[:, None] ^ homes[None, :]) <= THRESHOLD
        rows, cols = np.nonzero(near)
        if not len(rows):
            continue
        firsts = cols[np.searchsorted(rows, rows)]  # each visitor's first home
        own = cols == firsts
        out.extend((v, h) for v, h in zip(block[rows[own]].tolist(), homes[cols[own]].tolist()) if v != h)
        pairs = np.unique(np.stack([firsts[~own], cols[~own]], 1), axis=0)
        for a, b in pairs.tolist():
            x, y = _root(parent, a), _root(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(homes[a]), int(homes[b])))
    return out


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], int, np.ndarray]]:
    """Runs of rows of one anchor, block and role, in pieces of bounded size."""
    for batch in batches:
        keys = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("part", "anchor", "block", "role")]
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if not len(fps):
            continue
        change = np.zeros(len(fps), bool)
        change[0] = True
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(fps)]):
            for c in range(a, b, VISITOR_ROWS):
                yield (int(keys[0][a]), int(keys[1][a]), int(keys[2][a])), int(keys[3][a]), fps[c : min(b, c + VISITOR_ROWS)]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows: the homes (role 0) of an anchor's block come before its visitors (role 1)."""
    key, homes, parent = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found: list[tuple[int, int]] = []
    for at, role, fps in _sections(batches):
        if at != key:
            key, homes = at, np.zeros(0, np.uint64)
        if role == 0:
            homes = np.concatenate([homes, fps])
            parent = np.arange(len(homes))
        elif len(homes):
            found.extend(forest(homes, fps, parent))
        if len(found) >= 1 << 16:
            yield _as_links(found)
            found = []
    if found:
        yield _as_links(found)


def _as_links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2)
    low, high = pairs.min(axis=1), pairs.max(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], schema=LINKS)


def links(fps: DataFrame) -> DataFrame:
    """A spanning set of the links between distinct fingerprints: ``a`` > ``b``, distinct."""
    homes, visits = _homes_and_visits(fps)
    blocks = (
        homes.groupBy("part", "anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOME_ROWS)
        .select("part", "anchor", F.ceil(F.col("n") / HOME_ROWS).cast("int").alias("blocks"))
    )
    blocks = materialize(blocks)  # read by both sides; has a row per anchor with thousands of homes
    count = F.coalesce("blocks", F.lit(1))
    placed_homes = homes.join(blocks, ["part", "anchor"], "left").select(
        "part", "anchor", F.pmod(F.xxhash64("fp"), count).cast("int").alias("block"), F.lit(0).alias("role"), "fp"
    )
    placed_visits = visits.join(blocks, ["part", "anchor"], "left").select(
        "part", "anchor", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"), F.lit(1).alias("role"), "fp"
    )
    rows = placed_homes.unionByName(placed_visits)
    return (
        rows.repartition("part", "anchor", "block")
        .sortWithinPartitions("part", "anchor", "block", "role", "fp")
        .mapInArrow(_links, "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``root``: the smallest node each node is joined to, for nodes with a link, roots aside.

    Large-star and small-star in turn until neither changes the edges; both keep the components, and the
    depth shrinks by a factor a round. Minima are aggregated before they are joined back and written
    between, so that a node with very many neighbours is split by Spark's handling of skewed joins.
    """

    def minima(neighbours: DataFrame) -> DataFrame:
        return materialize(neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first())

    edges = materialize(edges)
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = both.join(minima(both), "u").filter(F.col("v") > F.col("u"))
        large = materialize(large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = minima(down)
        small = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = materialize(
            small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        )
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select("a", F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """A row per row: ``doc_id``, ``text_hash``, ``fp``, ``root`` (its group's smallest fingerprint) and
    ``component_id``, the smallest id that links lead to."""
    marked = materialize(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
        fingerprint(F.col(f"`{text}`"), size).alias("fp"),
    ))
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(first.select("fp"))).withColumnRenamed("a", "fp")
    rooted = materialize(
        first.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    )
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest id stays.

    Rows that share id and text count as one; rows without an id stay only where their whole group has none.
    """
    return first_of_groups(docs, near_duplicates(docs, doc_id, text, size), doc_id, text)


def first_of_groups(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group (``doc_id``, ``text_hash``, ``root``) the row with the smallest id, rows without one last."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")
    kept = materialize(groups.groupBy("root").agg(best).select("best.doc_id", "best.text_hash").distinct())
    repeated = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1")
    repeated = materialize(repeated.select("doc_id", "text_hash"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])

    rows = boxed(docs, doc_id=doc_id, text=text).select("doc", "doc_id", F.xxhash64("text").alias("text_hash"))
    single = kept.join(repeated, same(kept, repeated), "left_anti")
    several = materialize(kept.join(repeated, same(kept, repeated), "left_semi"))
    # Only rows that occur repeatedly have to meet; where there are none, the second part falls away.
    once = rows.join(single, same(rows, single), "left_semi")
    again = rows.join(several, same(rows, several), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    staying = once.unionByName(again)
    return unboxed(staying, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )

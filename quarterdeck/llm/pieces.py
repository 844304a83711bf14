"""SentencePiece encoding by sampled segmentation, and decoding.

A text's lattice has a node between any two characters and an edge for every piece of the vocabulary that
spells what lies between. An edge weighs as the piece's rank r, log 1 / (r + 1), times ``sharpness``; a
character without a piece has the bytes of its code as one edge. Forward filtering sums the weights of all
paths to each node; backward sampling draws edges from the end, each with its share of that sum. So every
segmentation has the probability of its weight among all of them.

No piece holds a space after another character, nor a line feed, so lattices never reach beyond a run of
spaces with the word after it. The distinct parts of some hundred texts are filtered in numpy, a block of about
one length at a time, and the draws for all places they stand at are made together.

Draws depend on the row's key, the part's place in the text and the step alone, so a row gets the same
segmentation on any executor, in any batch, after any retry. As in the vocabulary's own encoder, a text
begins with an added space, which decoding takes off. Decoding is lossless for every text.

Defined results: null gives null, an empty text no piece; a null key counts as the empty key; repeated rows
get the same pieces; a lower one-eighth block (U+2581) in a text is coded by its bytes. Decoding skips null
ids and control pieces.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from quarterdeck.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
PARTS = re.compile(r" *[^ \n]+| +|\n")
BYTE_WEIGHT = math.log(1 / 40_000)
#: Texts, and their characters unless one has more, whose lattices are held at a time.
TEXTS = 1024
CHARACTERS = 4_000_000
#: Edges filtered at a time, unless one part has more; few enough for a processor's cache.
CELLS = 1 << 18
#: The odd number that hashes of spellings are built with, and the places of the table that says which are in use.
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit words of counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """The pieces of a model file, with spaces for their mark, and a table to find them by hash."""

    def __init__(self, name: str) -> None:
        model = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = model.get_piece_size()
        self.byte, self.spelling, weight, pieces = [0] * 256, [b""] * n, np.full(n + 1, -np.inf), []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte[value], self.spelling[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(SPACE, " ")
                weight[i] = -math.log(min(max(-model.get_score(i), 0.0), float(n)) + 1)
                self.spelling[i] = piece.encode()
                pieces.append((piece, i))
        self.weight, self.longest = weight.astype(np.float32), max(len(p) for p, _ in pieces)
        hashes = np.array([self._hash(p) for p, _ in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for _, i in pieces], dtype=np.int32)[order]
        self.used = np.zeros(1 << SLOT_BITS, bool)
        self.used[self._slot(self.hashes)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - SLOT_BITS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        maybe = np.nonzero(self.used[self._slot(hashes)])
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == wanted, self.ids[at], -1)
        return out


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def _filtered(parts: list[str], words: Vocabulary, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """Of parts of about one length, per part and character: shares up to, and ids of, the edges that end there.

    Edge e spans e + 1 characters. An id of -2 - c stands for the bytes of character c, -1 for no edge.
    """
    size, n = max(map(len, parts)), len(parts)
    reach = min(words.longest, size)
    chars = np.array([p.ljust(size, "\0") for p in parts], dtype=f"<U{size}").view(np.uint32).reshape(n, size).astype(np.uint64)
    ids = np.full((n, size, reach), -1, np.int32)
    hashes = np.zeros((n, size), np.uint64)  # by start, of ever longer spellings
    for e in range(reach):
        hashes = hashes[:, : size - e] * BASE + chars[:, e:] + np.uint64(1)
        ids[:, e:, e] = words.find(hashes)
    weights = (words.weight * np.float32(sharpness))[ids]  # the last weight, where -1 points, is that of no edge
    spelt = ids[:, :, 0] < 0
    width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    weights[:, :, 0] = np.where(spelt, width * BYTE_WEIGHT * sharpness, weights[:, :, 0])
    ids[:, :, 0] = np.where(spelt, -2 - chars.astype(np.int64), ids[:, :, 0])
    sums = np.full((n, size + reach), -np.inf)  # of node k at k + reach - 1
    sums[:, reach - 1] = 0.0
    shares = np.empty((n, size, reach), np.float32)
    for k in range(size):
        into = sums[:, k : k + reach][:, ::-1] + weights[:, k]
        top = into.max(axis=1, keepdims=True)
        share = np.exp((into - top).astype(np.float32)).cumsum(axis=1)
        total = share[:, -1:]
        sums[:, k + reach] = (top + np.log(total))[:, 0]
        np.divide(share, total, out=shares[:, k])
    return shares, ids


def _blocks(sizes: list[int], longest: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Parts in an order where those of about one length stand together, and the borders of blocks of them."""
    classes = np.maximum(3, np.ceil(2 * np.log2(np.maximum(sizes, 1)))).astype(np.int64)
    order = np.argsort(classes, kind="stable")
    out, start = [], 0
    for c, n in zip(*np.unique(classes, return_counts=True)):
        size = int(2 ** (c / 2)) + 1
        step = max(1, CELLS // (size * min(size, longest)))
        out.extend((a, min(a + step, start + n)) for a in range(start, start + int(n), step))
        start += int(n)
    return order, out


def _drawn(
    parts: list[str], which: np.ndarray, stream: np.ndarray, words: Vocabulary, sharpness: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Edges drawn for occurrences ``which`` of a block of parts, last edge first: occurrences and ids."""
    shares, ids = _filtered(parts, words, sharpness)
    _, size, reach = shares.shape
    shares, ids = shares.reshape(-1, reach), ids.reshape(-1, reach)
    row, left = which * size - 1, np.array([len(p) for p in parts])[which]
    who, drawn, owners, step = np.arange(len(which)), [], [], 0
    while len(who):
        step += 1
        u = (_mixed(stream + np.uint64(step) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        at = row + left
        edge = np.count_nonzero(shares[at] <= u[:, None], axis=1)
        drawn.append(ids[at, edge])
        owners.append(who)
        left = left - edge - 1
        on = left > 0
        who, row, left, stream = who[on], row[on], left[on], stream[on]
    return np.concatenate(owners), np.concatenate(drawn)


def sample(
    keys: list[str | None], texts: list[str | None], words: Vocabulary, sharpness: float = 1.0, seed: int = 0,
) -> list[np.ndarray | None]:
    """A sampled segmentation of each text, as piece ids."""
    split = [PARTS.findall(" " + text) if text else [] for text in texts]
    counts = np.array([len(parts) for parts in split], dtype=np.int64)
    if not counts.any():
        return [None if t is None else np.zeros(0, np.int32) for t in texts]
    every = list(chain.from_iterable(split))
    parts = list(dict.fromkeys(every))
    number = dict(zip(parts, range(len(parts))))
    which = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    first = np.cumsum(counts) - counts
    hashes = np.array([xxhash.xxh64_intdigest(k or "", seed) for k in keys], dtype=np.uint64)
    place = (np.arange(len(which)) - np.repeat(first, counts)).astype(np.uint64)
    owners, drawn = [], []
    with np.errstate(over="ignore"):
        stream = _mixed(np.repeat(hashes, counts) + place * BASE)
        by_class, blocks = _blocks([len(p) for p in parts], words.longest)
        rank = np.empty(len(parts), np.int64)
        rank[by_class] = np.arange(len(parts))
        rank = rank[which]
        order = np.argsort(rank, kind="stable")
        borders = np.searchsorted(rank[order], [a for a, _ in blocks] + [len(parts)]).tolist()
        for (a, b), low, high in zip(blocks, borders, borders[1:]):
            here = order[low:high]
            owner, code = _drawn([parts[i] for i in by_class[a:b]], rank[here] - a, stream[here], words, sharpness)
            owners.append(here[owner])
            drawn.append(code)
    # Steps come last edge first; turned round, and by part, they are in text order.
    owner, code = np.concatenate(owners)[::-1], np.concatenate(drawn)[::-1]
    order = np.argsort(owner, kind="stable")
    owner, code = owner[order], code[order]
    odd = np.flatnonzero(code < 0)  # characters without a piece
    spelt = [[words.byte[b] for b in chr(-2 - c).encode("utf-8", "surrogatepass")] for c in code[odd].tolist()]
    n = np.ones(len(code), np.int64)
    n[odd] = [len(x) for x in spelt]
    starts = np.cumsum(n) - n
    owner, code = np.repeat(owner, n), np.repeat(code, n)
    for start, x in zip(starts[odd].tolist(), spelt):
        code[start : start + len(x)] = x
    borders = np.searchsorted(owner, [*first.tolist(), len(which)])
    return [None if t is None else code[a:b] for t, a, b in zip(texts, borders[:-1], borders[1:])]


def _portions(texts: pa.Array) -> list[tuple[int, int]]:
    """Starts and numbers of rows of portions of bounded size."""
    out, start, size = [], 0, 0
    for i, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (i - start == TEXTS or size + length > CHARACTERS):
            out.append((start, i - start))
            start, size = i, 0
        size += length
    return [*out, (start, len(texts) - start)] if len(texts) else out


def encode(key: Column, text: Column, seed: int = 0, sharpness: float = 1.0, model: str = MODEL) -> Column:
    """Piece ids of a text, sampled by the row's key."""

    @F.arrow_udf("array<int>")
    def sampled_pieces(keys: pa.Array, texts: pa.Array) -> pa.Array:
        chunks = []
        for at, n in _portions(texts):
            some = texts.slice(at, n).to_pylist()
            ids = sample(keys.slice(at, n).to_pylist(), some, vocabulary(model), sharpness, seed)
            present = [np.zeros(0, np.int32) if x is None else x for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in present])]).astype(np.int32)
            mask = pa.array([x is None for x in ids])
            chunks.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(present)), mask=mask))
        return pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(pa.int32()))

    return sampled_pieces(key.cast("string"), text)


def spelled(ids: np.ndarray, spelling: list[bytes]) -> str:
    text = b"".join(map(spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text that piece ids spell."""

    @F.arrow_udf("string")
    def decoded_text(lists: pa.Array) -> pa.Array:
        spelling, out = vocabulary(model).spelling, []
        for row in lists:
            out.append(spelled(row.values.drop_null().to_numpy(zero_copy_only=False), spelling) if row.is_valid else None)
        return pa.array(out, pa.string())

    return decoded_text(ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Behind ``inline`` the ids are drawn once; side by side with decoding, Spark would draw them for each.
    coded = docs.select(F.inline(F.array(F.struct(
        "doc_id", "text", encode(F.col("doc_id"), F.col("text")).alias("ids")
    ))))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        decode(F.col("ids")).eqNullSafe(F.col("text")).alias("lossless"),
    )

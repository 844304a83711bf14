"""Token ids by the ``tokenizers`` library, with caches for what natural text repeats.

The tokenizer first cuts a text into pre-tokens and never looks across them afterwards; its model then
codes each pre-token by itself. A space before a character that is not white space always begins a
pre-token, so texts are cut there, and parts that were seen before are looked up. A new part is cut into
pre-tokens, and the library's model codes those not seen before. Cutting by our own pattern is limited to
characters whose class is beyond doubt; other parts, and texts that hold an added token's string or odd
white space, are encoded whole by the library. The caches have a fixed number of entries.

Columns are cut by Arrow, some megabytes of texts at a time, at every space and between a letter or digit and a
sign that ends words, and each distinct part is looked up once; a text that this does not settle (none or white
space after a space, odd white space, an added token) is encoded by itself.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CACHE_PARTS = 400_000
CACHE_TOKENS = 200_000
CACHED_LENGTH = 48
#: Bytes of texts that are cut together; a longer text is cut alone.
BLOCK = 1 << 22
CUT = re.compile(r" (?=\S)")
#: A space beside other white space; only then does the plain split at spaces differ from ``CUT``.
SPACED = re.compile(r" (?:\s|\Z)")
ODD = re.compile("[\x1c-\x1f\x85᠎​⁠﻿]")

# Letters of sure class, and the tokenizer's own pattern over them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ一-龥ぁ-ゖァ-ヺ가-힣"
SURE = re.compile(rf"[\x20-\x7e\n\r\t{LETTERS}¿¡«»–—…“”‘’€]*")
TOKENS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: A pre-token always ends here; what follows is marked, since no space precedes it.
INNER, MARK = rf"([0-9{LETTERS}])([.,;:!?])", "\x01"

BYTE_LETTERS = _byte_letters()
SPACE = BYTE_LETTERS[0x20]
ENDINGS = ".,;:!?"


class Encoder:
    """A tokenizer of this process."""

    def __init__(self, name: str) -> None:
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokens: dict[str, bytes] = {}
        #: What follows a space, up to the next cut or to the end of its pre-token, and the ids of the space and it.
        self.parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, token: str) -> bytes:
        """The ids of a pre-token, by the library's model."""
        plain = token.isascii() and token.isprintable()
        letters = token.replace(" ", SPACE) if plain else token.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _token(self, token: str) -> bytes:
        code = self.tokens.get(token)
        if code is None:
            code = self._ids(token)
            if len(self.tokens) < CACHE_TOKENS and len(token) <= CACHED_LENGTH:
                self.tokens[token] = code
        return code

    def _keep(self, part: str, code: bytes, share: int = 1) -> bytes:
        """Into the cache, as long as a share of it, one in so many, is not full."""
        if share * len(self.parts) < CACHE_PARTS and len(part) <= CACHED_LENGTH:
            self.parts[part] = code
        return code

    def _word(self, word: str) -> bytes:
        """The ids of a space and what is one pre-token with it."""
        return self.parts.get(word) or self._keep(word, self._ids(" " + word))

    def _after_space(self, part: str, sure: bool, often: bool = False) -> bytes:
        """The ids of a space and a part, which begins with no white space."""
        if not sure and not SURE.fullmatch(part):
            return self._keep(part, self._whole(" " + part))
        if part.isalpha():
            return self._word(part)
        if part[-1] in ENDINGS and part[:-1].isalpha():
            code = self._word(part[:-1]) + self._token(part[-1])
        else:
            first, *rest = TOKENS.findall(" " + part)
            code = self._word(first[1:]) + b"".join(map(self._token, rest))
        return self._keep(part, code, 1 if often else 2)

    def _first(self, part: str, sure: bool) -> bytes:
        """The ids of a text's part before its first cut."""
        if not sure and not SURE.fullmatch(part):
            return self._whole(part)
        return b"".join(map(self._token, TOKENS.findall(part)))

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit words; none for null."""
        if not text:
            return b""
        sure = SURE.fullmatch(text) is not None
        if (not sure and ODD.search(text)) or any(a in text for a in self.added):
            return self._whole(text)
        parts = CUT.split(text) if SPACED.search(text) else text.split(" ")
        codes = list(map(self.parts.get, parts))
        codes[0] = self._first(parts[0], sure) if parts[0] else b""
        if None in codes:
            for i, code in enumerate(codes):
                if code is None:
                    codes[i] = self._after_space(parts[i], sure)
        return b"".join(codes)

    def _new(self, parts: list[str], times: list[int]) -> list[bytes | None]:
        """The ids of each part, with the space before it, found so many times; None where they depend on the rest of the text."""
        sure = SURE.fullmatch(" ".join(parts).replace(MARK, "")) is not None
        out: list[bytes | None] = []
        for part, n in zip(parts, times):
            if not part or part[0].isspace() or not sure and ODD.search(part):
                out.append(None)
            elif part[0] == MARK:
                out.append(self._first(part[1:], sure))
            else:
                out.append(self._after_space(part, sure, n > 1))
        return out

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text's begin, with the end of the last."""
        texts = texts.fill_null("")
        alone = np.any([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in (MARK, *self.added)], axis=0)
        plain = pc.if_else(pa.array(alone), "", texts) if alone.any() else texts
        plain = pc.replace_substring_regex(plain, INNER, rf"\1 {MARK}\2")
        lists = pc.split_pattern(plain, " ")
        words = pc.dictionary_encode(lists.flatten())
        distinct, place = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        starts = np.append(0, ends[:-1])
        codes = list(map(self.parts.get, distinct))
        new = [i for i, code in enumerate(codes) if code is None]
        times = np.bincount(place, minlength=len(distinct))[new].tolist()
        unsettled = []
        for i, code in zip(new, self._new([distinct[i] for i in new], times)):
            if code is None:
                unsettled.append(i)
            codes[i] = code or b""
        before = [distinct[i] for i in place[starts].tolist()]
        alone |= np.array([ODD.search(part) is not None for part in before])
        if unsettled:
            at = np.flatnonzero(np.isin(place, unsettled))
            alone[np.searchsorted(ends, np.setdiff1d(at, starts), side="right")] = True
        first = [
            self.encode(texts[i].as_py()) if whole else self._first(part, False) if part else b""
            for i, (part, whole) in enumerate(zip(before, alone.tolist()))
        ]
        # Numbers of distinct parts, then of first parts, nothing and the end id, in the order in which their ids follow.
        codes += [*first, b"", np.uint32(END_ID).tobytes()]
        if alone.any():
            place = np.where(np.repeat(alone, ends - starts), len(codes) - 2, place)
        place = np.insert(place, ends, len(codes) - 1)
        place[starts + np.arange(len(first))] = len(distinct) + np.arange(len(first))
        ids, sizes = np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        length = sizes[place]
        after = np.cumsum(length)
        number = np.int32 if after[-1] < 1 << 31 else np.int64
        at = np.repeat(((np.cumsum(sizes) - sizes)[place] - after + length).astype(number), length)
        at += np.arange(len(at), dtype=number)
        return ids[at], np.append(0, after[ends + np.arange(len(ends))])


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def encoded(texts: pa.Array, name: str = TOKENIZER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some texts at a time: the place of the first, the ids of all with end ids, and the bounds of each; a null text is empty."""
    after, at = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + BLOCK, side="right")))
        yield at, *encoder(name).encode_block(texts.slice(at, to - at))
        # What Arrow keeps for later would otherwise stay beside the caches for as long as the worker lives.
        pa.default_memory_pool().release_unused()
        at = to


def encode_with_end(texts: list[str | None], name: str = TOKENIZER) -> list[np.ndarray]:
    """Ids of each text and the end id; a null text is empty."""
    return [
        ids[a:b] for _, ids, bounds in encoded(pa.array(texts, pa.string()), name) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
    ]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))

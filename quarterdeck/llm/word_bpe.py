"""Token ids of a word-level BPE by the ``tokenizers`` library, with a cache of parts between white space.

The tokenizer drops white space and no token crosses it; its normal forms and its lower case look at one
character, or at one and the marks on it, so never across white space either. Texts are cut at spaces, line
feeds, carriage returns and tabs, and parts seen before are looked up. A new part whose characters are of
sure class and single case is cut into pre-tokens here and coded by the library's model; any other part, and
one that could hold an added token, is encoded by the library. The caches have a fixed number of entries.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarterdeck.llm.bpe import BYTE_LETTERS, LETTERS, SURE

CACHE_ENTRIES = 500_000
CACHED_LENGTH = 48
#: Texts are cut in blocks of so many characters, at white space, to bound the list of parts.
BLOCK = 1 << 20

# The tokenizer's own pattern over letters of sure class.
TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")


class WordEncoder:
    """A tokenizer of this process."""

    def __init__(self, name: str) -> None:
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.library.model
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.tokens: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        low = part.lower()
        if low.isalpha() and low.isascii():
            code = self._token(low)
        elif SURE.fullmatch(low) and not any(a in low for a in self.added):
            code = b"".join(map(self._token, TOKENS.findall(low)))
        else:
            code = np.array(self.library.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self._keep(self.parts, part, code)

    def _token(self, token: str) -> bytes:
        code = self.tokens.get(token)
        if code is None:
            letters = token if token.isascii() else token.encode().decode("latin-1").translate(BYTE_LETTERS)
            code = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            self._keep(self.tokens, token, code)
        return code

    @staticmethod
    def _keep(cache: dict[str, bytes], key: str, code: bytes) -> bytes:
        if len(cache) < CACHE_ENTRIES and len(key) <= CACHED_LENGTH:
            cache[key] = code
        return code

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit words; none for null."""
        if not text:
            return b""
        text = text.replace("\n", " ").replace("\r", " ").replace("\t", " ")
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= BLOCK else text.find(" ", at + BLOCK)
            end = len(text) if end < 0 else end
            parts = text[at:end].split(" ")
            codes = list(map(self.parts.get, parts))
            if None in codes:
                for i, code in enumerate(codes):
                    if code is None:
                        codes[i] = self._part(parts[i])
            out.append(b"".join(codes))
            at = end + 1
        return b"".join(out)


@lru_cache(maxsize=2)
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)

"""Pre-tokens and their ids, exactly as the tokenizers library gives them, with a cache in each worker.

A byte-pair vocabulary encodes each pre-token by itself, so a text's ids are those of its pre-tokens in turn. Texts whose
characters all lie in a range where Python's and the library's character classes agree are split by Python's regular
expressions; for any other text the library's own normaliser and pre-tokeniser do it.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

from tokenizers import Tokenizer

from graphloom.llm.workers import held

#: Code points below this are split by Python, but for one whose lower case has two code points.
LIMIT, APART = 0x180, "İ"
#: A worker's cache holds this many pre-tokens, of so many characters at most, and as many that it held before.
CACHED, LONGEST = 300_000, 64


def _members(test: Callable[[str], bool]) -> str:
    return "".join(re.escape(chr(c)) for c in range(LIMIT) if test(chr(c)))


_L = _members(lambda c: unicodedata.category(c)[0] == "L")
_N = _members(lambda c: unicodedata.category(c)[0] == "N")
_S = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_ODD = re.compile(f"[^\\x00-{chr(LIMIT - 1)}]|{APART}")
#: The pre-token patterns of the two public vocabulary files.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
BYTE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Encoder(dict):
    """Maps a pre-token to what ``value`` makes of its ids; misses are encoded and kept."""

    def __init__(self, path: str, value: Callable[[list[int]], object], known: dict | None = None) -> None:
        super().__init__(known or {})
        self.known = known or {}
        self.before: dict = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.value = value
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.normalizer = self.tokenizer.normalizer
        self.pattern = BYTE if self.normalizer is None else WORD
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.hint = os.path.commonprefix(list(self.special)) if added else ""
        #: What the library's pre-tokeniser writes for each character that Python's patterns can meet.
        self.letters = {c: "".join(p for p, _ in self.split.pre_tokenize_str(chr(c))) for c in range(LIMIT)}
        self.parts: dict[str, object] = {}  # the library's own pre-tokens, in byte letters

    def __missing__(self, token: str):
        made = self.before.get(token)
        if made is None:
            made = self.value([t.id for t in self.model.tokenize(token.translate(self.letters))])
        if len(token) <= LONGEST:
            if len(self) >= len(self.known) + CACHED:
                self.before = dict(self)
                self.clear()
                self.update(self.known)
            self[token] = made
        return made

    def _by_library(self, text: str) -> Iterator[object]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        for part, _ in self.split.pre_tokenize_str(text):
            made = self.parts.get(part)
            if made is None:
                made = self.value([t.id for t in self.model.tokenize(part)])
                if len(part) <= LONGEST:
                    if len(self.parts) >= CACHED:
                        self.parts.clear()
                    self.parts[part] = made
            yield made

    def values(self, text: str) -> Iterator[object]:  # type: ignore[override]
        """What each pre-token of a text maps to, in order; special strings are the tokens they name."""
        if self.specials is not None and self.hint in text:
            for i, piece in enumerate(self.specials.split(text)):
                if i % 2:
                    yield self.value([self.special[piece]])
                elif piece:
                    yield from self._plain(piece)
        else:
            yield from self._plain(text)

    def _plain(self, text: str) -> Iterator[object]:
        if _ODD.search(text):
            return self._by_library(text)
        return map(self.__getitem__, self.pattern.findall(text.lower() if self.normalizer is not None else text))

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text that Python can split, else none."""
        return [] if _ODD.search(text) else self.pattern.findall(text.lower() if self.normalizer is not None else text)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


def worker_encoder(path: str, kind: str, known: dict | None = None) -> Encoder:
    """The encoder this worker process keeps between tasks. kind: "length" or "bytes"."""
    key = (path, kind, len(known or {}), sum(map(len, known)) if known else 0)
    return held(key, lambda: Encoder(path, len if kind == "length" else packed, known))


assert sys.byteorder == "little" and array("I").itemsize == 4

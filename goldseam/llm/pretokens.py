"""Pre-tokens of the two byte-level tokenizers, as the tokenizers library makes them.

Text of the scripts below is split here; a segment with any other character goes through the
library's own normalizer and pre-tokenizer, whose Unicode version decides there. The class lists
hold for all characters below U+0180, which tests compare with the library one by one.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

# The letters, numbers and white space below U+0180.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\\t-\\r \u0085 "
_APOSTROPHE = "'s|'t|'re|'ve|'m|'ll|'d"

# Latin prose also has dashes, quotation marks and the euro sign, which are in no class above.
_OTHER_SCRIPT = re.compile("[^\u0000-ſ‐-‧‰-›€]")

_BYTE_LEVEL = re.compile(
    f" ?[{_LETTER}]+|{_APOSTROPHE}| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD_LEVEL = re.compile(f"{_APOSTROPHE}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """(library tokenizer, parsed file) once per worker process; ``name`` lies beside the installed files."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        return Tokenizer.from_file(path), json.load(file)


class PreTokenizer:
    """Splits texts into special tokens (as ids) and pre-tokens (as text)."""

    def __init__(self, name: str) -> None:
        self.library, parsed = tokenizer(name)
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"] if t["special"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.by_word = parsed["model"]["end_of_word_suffix"] is not None

    def segments(self, text: str):
        """Pieces between special tokens, and the special tokens themselves, in order."""
        if "<|" not in text:
            return [text]
        return [piece for piece in self._cut.split(text) if piece]

    def split(self, segment: str) -> list[str]:
        """Pre-tokens of a piece that is no special token, as plain (not byte-mapped) text."""
        if _OTHER_SCRIPT.search(segment):
            return self._by_library(segment)
        if self.by_word:
            return _WORD_LEVEL.findall(segment.lower())
        return _BYTE_LEVEL.findall(segment)

    def _by_library(self, segment: str) -> list[str]:
        if self.by_word:
            segment = self.library.normalizer.normalize_str(segment)
        return [segment[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(segment)]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in symbols)
    symbols |= {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [symbols[b] for b in range(256)]

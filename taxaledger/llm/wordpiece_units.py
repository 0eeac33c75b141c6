"""Splitting texts into units that the word-end BPE tokenizer encodes independently.

The tokenizer normalizes (NFC, one space for white space, lower case), drops
white space and matches letters, single digits or other signs; no match spans
white space and NFC composes nothing across it. So a text's tokens are those of
its white-space separated units, in order. Signs whose class as white space
differs between libraries send a text down the whole-text path.
"""

from __future__ import annotations

import json
import re
import unicodedata

from tokenizers import Tokenizer

#: Control and format characters that not all libraries count as (or not as) white space.
DOUBTFUL = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")

#: From here on the library itself splits, as its Unicode tables may be of another version.
BEYOND = "\u0250"

#: Fixed value: the tokenizer's own pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """One printable letter for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def latin(kind: str) -> str:
    """The characters below BEYOND of a general category."""
    return "".join(c for c in map(chr, range(ord(BEYOND))) if unicodedata.category(c)[0] == kind)


#: The same split for characters below BEYOND, or a line end between units.
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+|\n".format(L=latin("L"), N=latin("N")))

BYTE_OF = {c: b for b, c in enumerate(byte_letters())}


class WordTokenizer:
    """The library's tokenizer and its parts, set as the contracts ask."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        marks = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.has_special, self.specials = marks.search, marks.finditer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spec = spec["model"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != PATTERN or self.spec["end_of_word_suffix"] is None or any(re.search(r"\s", s) for s in self.special):
            raise ValueError(f"{path} is no word-end BPE tokenizer of the expected kind")

    def pieces(self, text: str) -> list[bytes | int]:
        """The pieces of any text in UTF-8, split by the library; for a special string its id."""
        out, at = [], 0
        for m in self.specials(text):
            out += self._between(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._between(text[at:])

    def _between(self, text: str) -> list[bytes]:
        """The pieces of a text without special strings."""
        if not text:
            return []
        plain = self.whole.normalizer.normalize_str(text)
        return [bytes(map(BYTE_OF.__getitem__, p)) for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(plain)]

    def unit_pieces(self, new: list[str]) -> list[list[bytes | int]]:
        """The pieces of each unit (without white space).

        Units of Latin letters, which NFC leaves alone, are lowered and split
        all together; the library splits the others one by one.
        """
        plain = [u for u in new if max(u) < BEYOND and not self.has_special(u)]
        lists, held = iter([]), []
        if plain:
            said = [held]
            for piece in LATIN_PIECES.findall("\n".join(plain).lower()):
                if piece == "\n":
                    said.append(held := [])
                else:
                    held.append(piece.encode())
            lists = iter(said)
        simple = set(plain)
        return [next(lists) if u in simple else self.pieces(u) for u in new]


def units(text: str | None) -> list[str] | None:
    """The white-space separated units, or None where the text holds doubtful signs."""
    return None if text and DOUBTFUL.search(text) else (text or "").split()

"""Counts of whole texts: blank-separated words, characters by class, repeated lines and word windows."""

from __future__ import annotations

import numpy as np

from taxaledger.llm.diagonals import nearest_earlier

#: Character classes; the last one is any character beyond ASCII.
CLASSES = ("lower", "upper", "digit", "blank", "sentence", "sign", "beyond")
BLANKS = b" \t\n\x0b\x0c\r"
SENTENCE = b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>"


def _class_of_byte() -> np.ndarray:
    """A class for each byte; bytes that continue a character count for none (the number after the last class)."""
    of = np.full(256, CLASSES.index("sign"))
    for name, chars in (("lower", range(ord("a"), ord("z") + 1)), ("upper", range(ord("A"), ord("Z") + 1)), ("digit", range(ord("0"), ord("9") + 1)), ("blank", BLANKS), ("sentence", SENTENCE)):
        of[list(chars)] = CLASSES.index(name)
    of[0x80:0xC0] = len(CLASSES)
    of[0xC0:] = CLASSES.index("beyond")
    return of


_OF = _class_of_byte()
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def repeated_windows(numbers: np.ndarray, text: np.ndarray, size: int = 5) -> np.ndarray:
    """Mask of the words inside a window of ``size`` (4 or more) words that its text holds twice or more.

    ``numbers``: of the words of texts laid end to end; ``text``: of each word's text.
    Windows get exact numbers by doubling; only those that stand twice go on.
    """
    n = len(numbers)
    inside = np.zeros(n + 1, np.int64)
    if n < size:
        return inside[:n].astype(bool)
    at = np.arange(n)
    _, number, often = nearest_earlier(text.astype(np.int64) * (int(numbers.max()) + 1) + numbers, at)
    single = number.copy()
    at, number, held, length = at[often], number[often], np.full(n, -1, np.int64), 1
    while length < size and len(at):
        step = min(length, size - length)
        if step == length:
            held[:] = -1
            held[at] = number
        elif step == 1:
            held = single
        else:
            raise ValueError("a window of 2**k or 2**k + 1 words")
        before = np.where(at >= length, held[np.maximum(at - length, 0)], -1)
        both = before >= 0
        at, keys = at[both], number[both] * (int(held.max(initial=0)) + 1) + before[both]
        if not len(at):
            break
        _, number, often = nearest_earlier(keys, at)
        at, number, length = at[often], number[often], length + step
    if length == size:
        np.add.at(inside, at - size + 1, 1)
        np.add.at(inside, np.minimum(at + 1, n), -1)
    return np.cumsum(inside[:n]) > 0


class Measures:
    """``known``: the distinct words and their numbers; ``number``, ``text``: of each word; the rest: one entry a text."""

    def __init__(self, texts: list[bytes]):
        size = len(texts)
        split = [t.split() for t in texts]  # bytes: the six ASCII blanks only
        self.n_words = np.fromiter(map(len, split), np.int64, size)
        self.known: dict[bytes, int] = {}
        known = self.known
        self.number = np.fromiter((known.setdefault(w, len(known)) for own in split for w in own), np.int64, int(self.n_words.sum()))
        self.text = np.repeat(np.arange(size), self.n_words)
        del split
        data = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(size), np.fromiter(map(len, texts), np.int64, size))
        k = len(CLASSES) + 1
        self.classes = np.bincount(owner * k + _OF[data], minlength=size * k).reshape(size, k)[:, :-1]
        self.word_chars = self.classes.sum(axis=1) - self.classes[:, CLASSES.index("blank")]
        self.n_symbols = np.bincount(owner[_SYMBOL[data]], minlength=size)
        self.n_dup_lines = np.fromiter((self._repeated_lines(t) for t in texts), np.int64, size)
        self.n_repeat_words = np.bincount(self.text[repeated_windows(self.number, self.text)], minlength=size)

    @staticmethod
    def _repeated_lines(text: bytes) -> int:
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        return len(lines) - len(set(lines))

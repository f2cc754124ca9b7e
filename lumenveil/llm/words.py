"""Normalised words of whole texts, hashed for a whole batch at once with numpy.

Texts are laid end to end in one byte buffer; word bounds and 64-bit word hashes come from array
operations, so no Python code runs per word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import numpy as np

#: Letters that look like Latin ones (fixed values): Cyrillic, then Greek.
LOOKALIKES = str.maketrans(
    "аАВеЕЗКМНоОрРсСТуУхХіІјЈѕЅԁһԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρ",
    "aABeE3KMHoOpPcCTyYxXiIjJsSdhqw" + "ABEZHIKMNOPTYXoavip",
)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_NOT_WORD = re.compile(r"[\W_]+")
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\(?:[nrtbf]|u00[aA]0)")
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[~_IS_WORD] = 0
_POWER = np.cumprod(np.full(4096, _MULTIPLIER, dtype=np.uint64))


def normalise(text: str) -> str:
    """Lower case without markup, escapes, invisible and look-alike characters; words kept apart."""
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).translate(LOOKALIKES)
        return _NOT_WORD.sub(" ", text.lower())
    return text.lower()


def words_of(normalised: str) -> list[str]:
    return _NOT_WORD.sub(" ", normalised).split()


@dataclass
class WordBatch:
    """Words of consecutive texts: byte bounds, hash, and number of the text of each word."""

    buffer: bytes
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    text: np.ndarray

    def slice(self, first: int, last: int) -> str:
        """The normalised text from word ``first`` to word ``last``."""
        return self.buffer[self.start[first] : self.end[last]].decode("utf-8", "replace")


def word_batch(texts: list[str]) -> WordBatch:
    """Hash all words of ``texts`` (already normalised)."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    buffer = b"\n".join(encoded) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return WordBatch(buffer, none, none, np.zeros(0, np.uint64), none)
    length = end - start
    offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    chars = raw[inside]
    with np.errstate(over="ignore"):
        part = _VALUE[chars] * _POWER[np.minimum(offset, 4095)]
        value = np.add.reduceat(part, np.cumsum(length) - length)
    text_start = np.cumsum([0] + [len(e) + 1 for e in encoded])
    text = np.searchsorted(text_start, start, side="right") - 1
    return WordBatch(buffer, start, end, value, text)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def masked_windows(batch: WordBatch, mask: tuple[int, ...], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of the mask's span inside one text; only masked positions count."""
    span = mask[-1] + 1
    n = len(batch.value) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(batch.text[:n] == batch.text[span - 1 :])
    h = np.full(len(inside), (seed * _MULTIPLIER) & _MASK, np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(mask):
            h = h * np.uint64(0xD1342543DE82EF95) + batch.value[inside + p] * np.uint64(2 * k + 1)
    return inside, mix(h)

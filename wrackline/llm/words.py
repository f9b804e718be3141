"""Words and word n-grams of texts as 64-bit hashes, a batch of texts at a time.

Words are runs of letters and digits, in lower case, accents removed. Hashes are
the same in every process (xxh3), so they can be shuffled, joined and stored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)


@lru_cache(100_000)
def _unaccented(run: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", run) if not unicodedata.combining(c)).lower()


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else _OTHER.sub(lambda m: _unaccented(m[0]), text)


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []


class WordHashes(dict):
    """word -> hash, filled as words come; emptied when it holds `most` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed(texts: Iterable[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    lists = [words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(lengths.sum()), np.uint64)
    at = 0
    for ws in lists:
        flat[at : at + len(ws)] = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
        at += len(ws)
    return flat, lengths


def grams(flat: np.ndarray, lengths: np.ndarray, k: int, mask: tuple[int, ...] | None = None):
    """Hash, text number and position of each window of k words; a mask names the places that count."""
    n = max(0, len(flat) - k + 1)
    text = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    value = np.zeros(n, np.uint64)
    for i in mask if mask is not None else range(k):
        value = (value + flat[i : i + n]) * _MIX
        value ^= value >> _SHIFT
        value += np.uint64(i)
    inside = text[:n] == text[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    where = np.flatnonzero(inside)
    return value[where], text[where], where - first[text[where]]


def distinct(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, value) pairs, sorted."""
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
        value, text = value[new], text[new]
    return value, text

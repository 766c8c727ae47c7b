"""Hashes of words and of word n-grams, in numpy."""

import hashlib

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    """The words of a text: bytes.split() parts at space and \\x09 to \\x0d, and at nothing else."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out = out * _MIX + h[k : m + k]
    return mixed(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted set of a text's n-gram hashes; a text of fewer words has one shingle, of all its words; without words, none."""
    h = word_hashes(split(text))
    return np.unique(ngrams(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A number for a set, as good as unique (63 bits)."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big") >> 1

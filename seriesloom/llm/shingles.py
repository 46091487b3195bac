"""Hashes of words and word shingles, computed over whole byte arrays inside a task."""

from __future__ import annotations

import hashlib

import numpy as np

_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of more blocks of eight bytes are hashed one by one.
_BLOCKS = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where each run of bytes other than those of `between` (ASCII white space) starts and ends."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~between[raw]
    edges = np.flatnonzero(np.diff(inside))
    return raw, edges[0::2], edges[1::2]


def word_hashes(data: bytes, between: np.ndarray = _SPACE, salt: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, in order.

    Every eight bytes are scrambled into the state before the next ones follow, so that no arithmetic relation between words carries
    over to their hashes; words of one length up to eight bytes never share one.
    """
    raw, starts, ends = word_spans(data, between)
    lengths = ends - starts
    state = mix(lengths.astype(np.uint64) * _STEP + np.uint64(salt))
    if not len(starts):
        return state, starts, ends
    eights = np.ndarray(len(raw), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from every place on
    todo = np.flatnonzero(lengths <= 8 * _BLOCKS)
    at = 0
    while len(todo):
        block, left = eights[starts[todo] + at], lengths[todo] - at
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        state[todo] = mix(state[todo] ^ block) + _STEP
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(lengths > 8 * _BLOCKS).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([salt])).digest(), "little")
    return state, starts, ends


class Joined:
    """The words of several texts in a row: their hashes, where they lie in the joined bytes, and the text of each."""

    def __init__(self, texts: list[bytes], between: np.ndarray = _SPACE) -> None:
        self.data = b"\n".join(texts)
        self.hashes, self.starts, self.ends = word_hashes(self.data, between)
        self.offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.owner = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.owner, minlength=len(texts))


def chained(words: np.ndarray, at: np.ndarray | int, width: int) -> np.ndarray:
    """Hash of the `width` words from each place `at` on, scrambled after each word (0: from every place that has so many)."""
    if isinstance(at, int):
        runs = len(words) - width + 1
        total = np.full(max(0, runs), width, np.uint64)
        for k in range(width if runs > 0 else 0):
            total = mix(total ^ words[k : k + runs]) + _STEP
        return total
    total = np.full(len(at), width, np.uint64)
    for k in range(width):
        total = mix(total ^ words[at + k]) + _STEP
    return total


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text is one run, a text without words has none."""
    words = word_hashes(data)[0]
    if not len(words):
        return words
    return np.unique(chained(words, 0, min(width, len(words))))


def named_set(data: bytes, width: int) -> tuple[np.ndarray, bytes | None]:
    """A text's shingle set, and a name of the set from two independent hashes of each shingle, 128 bits together."""
    words = word_hashes(data)[0]
    if not len(words):
        return words, None
    width = min(width, len(words))
    hashes, first = np.unique(chained(words, 0, width), return_index=True)
    others = chained(word_hashes(data, salt=2)[0], 0, width)[first]
    return hashes, hashlib.blake2b(hashes.tobytes() + others.tobytes(), digest_size=16).digest()

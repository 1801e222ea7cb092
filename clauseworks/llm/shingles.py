"""Word shingles of many texts at a time, as 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes of text hashed at a time, and of a word up to which it is hashed by eight bytes.
SLICE = 1 << 21
LONG = 256

# Odd multipliers of the hashes.
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in zip((30, 27), _MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and where it ends."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.r_[True, gap, True].view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` begins, and its hash: words lie between ASCII white space.

    A word's hash takes in eight bytes at a time and is mixed after each, so that words of up to eight bytes never
    share one and no rule makes longer words do so; words above LONG bytes get a cryptographic one.
    """
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    begin, end = _edges(raw[:-8])
    size = end - begin
    eights = np.lib.stride_tricks.sliding_window_view(raw, 8)
    out = _mixed(size.astype(np.uint64) * np.uint64(_BASE))
    at = np.flatnonzero(size <= LONG)
    done = 0
    while len(at):
        left = size[at] - done
        eight = np.ascontiguousarray(eights[begin[at] + done]).view("<u8").ravel() & _MASKS[np.minimum(left, 8)]
        out[at] = _mixed(out[at] ^ eight) + np.uint64(_BASE)
        at = at[left > 8]
        done += 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little")
    return begin, out


def _long(data: bytes) -> np.ndarray:
    """The hashes of the words of a text longer than a slice, cut at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    total = np.zeros(max(1, n - WORDS + 1), dtype=np.uint64)
    if n < WORDS:  # the whole sequence as one
        for k in range(n):
            total += words[k : k + 1] * np.uint64(_PLACES[k])
        return _mixed(total + np.uint64(n))
    for k in range(WORDS):
        total += words[k : n - WORDS + 1 + k] * np.uint64(_PLACES[k])
    return _mixed(total + np.uint64(WORDS))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text, of lower-cased (A to Z) words."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    data = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    i = 0
    while i < len(data):
        if len(data[i]) > SLICE:
            out[i] = np.unique(_shingles(_long(data[i])))
            i += 1
            continue
        j, size = i, 0
        while j < len(data) and size + len(data[j]) + 1 <= SLICE + 1:
            size += len(data[j]) + 1
            j += 1
        j = max(j, i + 1)
        joined = b"\n".join(data[i:j])
        begins, hashes = word_hashes(joined)
        # words of each text: those that begin before its end
        ends = np.searchsorted(begins, np.cumsum([len(d) + 1 for d in data[i:j]]))
        at = 0
        for k, end in zip(range(i, j), ends.tolist(), strict=True):
            s = _shingles(hashes[at:end])
            s.sort()
            out[k] = s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s
            at = end
        i = j
    return out


def set_ids(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit ids of a set: equal sets have equal ids."""
    raw = hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)

"""Encodes texts piece by piece, each distinct piece once: what both token operators share.

A byte-level BPE with the usual pattern never makes a token over the place before a space that follows a
non-space character. So a text may be cut there, and its ids are those of its pieces in turn. The ids of pieces
are kept, up to a set number of them, from batch to batch in a Python worker.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa

#: Pieces kept in a worker, characters cut into pieces at a time, and rows and bytes in an Arrow batch: bounds of memory.
MAX_KEPT = 300_000
SLICE = 1_000_000
ROWS = 1_000
BATCH_BYTES = 8_000_000

#: Marks at a piece's end that a byte-level BPE takes apart from the letter or digit before.
_MARKS = ".,;:!?"

Encode = Callable[[list[str]], list[bytes]]

_held: list[tuple[object, object]] = []


def held(key: object, make: Callable[[], object]):
    """What ``make`` gives for ``key``, kept for the next tasks of a Python worker, which keeps one such thing at a time.

    Workers serve one stage after another: what an earlier one was built for would stay beside what the next one needs.
    """
    if not _held or _held[0][0] != key:
        if _held:
            _held.clear()
            _give_back()
        _held.append((key, make()))
        _give_back()  # what making it took
    return _held[0][1]


def _give_back() -> None:
    """Returns freed memory to the system, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_batches(spark, rows: int = ROWS) -> None:
    """Lowers the rows and the bytes of an Arrow batch, as these may hold long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in slices of about ``size`` characters, each but the first beginning with a space that may be cut at."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Pieces:
    """Ids, as little-endian unsigned 32-bit integers, of texts.

    ``encode`` gives those of whole strings; ``encode_pieces`` those of pieces, each of which begins with its one
    space and does not end with white space.
    """

    def __init__(self, encode: Encode, encode_pieces: Encode | None = None, max_kept: int = MAX_KEPT):
        self._encode, self._encode_pieces, self._max = encode, encode_pieces or encode, max_kept
        self._kept: dict[str, bytes | str] = {}

    def _learn(self, new: list[str]) -> None:
        # A word and the marks after it are cut once more, as more texts share the word alone.
        words = [p.rstrip(_MARKS) for p in new]
        cut = [len(w) if len(w) < len(p) and w and w[-1].isalnum() else 0 for p, w in zip(new, words, strict=True)]
        todo = list(dict.fromkeys(w if e else p for p, w, e in zip(new, words, cut, strict=True)))
        todo = [p for p in todo if p not in self._kept]
        # A piece that is empty or ends with white space may not be cut from the next: its text goes another way.
        good = [p for p in todo if p and not p[-1].isspace()]
        self._kept.update(dict.fromkeys(todo, ""))
        self._kept.update(zip(good, self._encode_pieces([" " + p for p in good]), strict=True))
        marks = list({p[e:] for p, e in zip(new, cut, strict=True) if e})
        ids = dict(zip(marks, self._encode(marks), strict=True))
        self._kept.update((p, self._kept[p[:e]] + ids[p[e:]]) for p, e in zip(new, cut, strict=True) if e)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        todo: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for s in slices(text):
                todo.append((i, s))
                size += len(s)
                if size >= SLICE:
                    self._some(todo, out)
                    todo, size = [], 0
        self._some(todo, out)
        return [b"".join(x) for x in out]

    def _some(self, todo: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        parts: list[str] = []
        cut = []
        for i, s in todo:
            now = s.split(" ")
            first = now[0]  # without a space before it, or empty where the slice begins with that space
            if first and first[-1].isspace():
                first, now = s, now[:1]
            cut.append((i, s, first, len(parts), len(parts) + len(now) - 1))
            parts += now[1:]
        ids = list(map(self._kept.get, parts))
        missing = []
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            missing.append(at)
        if missing:
            new = [parts[k] for k in missing]
            self._learn(list(dict.fromkeys(new)))
            for k, p in zip(missing, new, strict=True):
                ids[k] = self._kept[p]
        whole: list[tuple[list[bytes], int, str]] = []
        for i, s, first, a, b in cut:
            try:
                rest = b"".join(ids[a:b])
                if first:
                    whole.append((out[i], len(out[i]), first))
                    out[i].append(b"")
                out[i].append(rest)
            except TypeError:  # a piece that may not be cut off
                whole.append((out[i], len(out[i]), s))
                out[i].append(b"")
        for (to, at, _), x in zip(whole, self._encode([s for *_, s in whole]), strict=True):
            to[at] = x
        if len(self._kept) > self._max:
            # the half that came first has the common pieces
            self._kept = dict(islice(self._kept.items(), self._max // 2))

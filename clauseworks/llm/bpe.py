"""Byte-level BPE, encoding and decoding, in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the rank of every pair of neighbours is found by
binary search over the sorted pair keys, each word's lowest-ranked pair is merged wherever it stands in the word,
and words without a pair that merges leave the array. Ids equal those of the tokenizers library for the same file.

Defined cases: a null or empty text has no ids and decodes to an empty text; the string of a special token in a
text becomes that token; repeated rows are encoded each; columns besides the text pass through;
an empty table gives no rows; texts of any length are encoded whole, in slices of about ``SLICE`` characters, but one word
of hundreds of thousands of letters takes more than linear time (8 seconds for 400,000).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseworks.llm.chunks import Pieces, held, small_batches

# The pattern that splits a text into words, with white space spelt out.
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_S = "".join(map(chr, _SPACES))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + hidden.index(b)) for b in range(256)]


class Bpe:
    """Reads a tokenizer file of kind BPE with a byte-level pre-tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        n = max([*vocab.values(), *self.added.values()]) + 1
        self._span = n
        self._byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * n + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        by_key = np.argsort(keys, kind="stable")
        self._keys, self._rank, self._made = keys[by_key], by_key.astype(np.int64), made
        each = np.arange(256)
        self._byte_ranks = self._ranks(self._byte_id[np.repeat(each, 256)], self._byte_id[np.tile(each, 256)]).reshape(256, 256)
        strings = [b""] * n
        for t, i in vocab.items():
            strings[i] = b"".join(back[c] for c in t)
        for t, i in self.added.items():
            strings[i] = t.encode()
        self._len = np.array([len(s) for s in strings], dtype=np.int64)
        self._at = np.concatenate([[0], np.cumsum(self._len)[:-1]])
        self._bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self._words = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search over the sorted pair keys; a pair that never merges has the last."""
        last = len(self._rank)
        if not last:
            return np.zeros(len(left), np.int32)
        keys = left * self._span + right
        found = np.minimum(np.searchsorted(self._keys, keys), last - 1)
        return np.where(self._keys[found] == keys, self._rank[found], last).astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, ids of each word) of words of one byte or more."""
        if not words:
            return np.empty(0, np.int64), np.zeros(0, np.int64)
        last = len(self._rank)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self._byte_id[raw]
        word = np.arange(len(words))  # of the words still in the array, by their place in it
        ends = np.cumsum(sizes)
        # rank[i]: of the pair that begins at i; none begins at a word's last symbol
        rank = np.full(len(raw), last, dtype=np.int32)
        rank[:-1] = self._byte_ranks[raw[:-1], raw[1:]]
        rank[ends - 1] = last
        done_at, done_size, done = [], [], []
        while len(word):
            best = np.minimum.reduceat(rank, ends - sizes)
            live = best < last
            if not live.all():
                stays = np.repeat(live, sizes)
                done.append(symbols[~stays])
                done_at.append(word[~live])
                done_size.append(sizes[~live])
                symbols, rank = symbols[stays], rank[stays]
                word, sizes, best = word[live], sizes[live], best[live]
                if not len(word):
                    break
                ends = np.cumsum(sizes)
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # of pairs that overlap, as in aaa, the first, third and so on are merged
            run = np.r_[True, np.diff(at) != 1]
            if not run.all():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[at] = self._made[rank[at]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[at + 1] = False
            ended = rank[at + 1] == last  # the pair's right symbol may have been the word's last
            rank[at] = -1
            at_word_end = np.zeros(len(symbols), dtype=bool)
            at_word_end[ends - 1] = True
            at_word_end[at] |= at_word_end[at + 1] & ended
            gone = np.add.reduceat(~stays, ends - sizes)
            symbols, rank, at_word_end = symbols[stays], rank[stays], at_word_end[stays]
            sizes = sizes - gone
            ends = np.cumsum(sizes)
            # only the pairs beside a merge are new
            here = np.flatnonzero(rank == -1)
            before = here[here > 0] - 1
            before = before[~at_word_end[before]]
            beside = np.concatenate([here[~at_word_end[here]], before])
            rank[here] = last
            rank[beside] = self._ranks(symbols[beside], symbols[beside + 1])
        at, size = np.concatenate(done_at), np.concatenate(done_size)
        ids, begins = np.concatenate(done), np.cumsum(size) - size
        order = np.argsort(at, kind="stable")
        counts = size[order]
        first = np.cumsum(counts) - counts
        return ids[np.repeat(begins[order] - first, counts) + np.arange(len(ids))], counts

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        """Ids of each string, as little-endian unsigned 32-bit integers; equal words are merged once."""
        number: dict[str, int] = {}
        of = []
        for s in strings:
            words: list[int] = []
            at = 0
            for m in self._special.finditer(s) if self._special else ():
                words += [number.setdefault(w, len(number)) for w in self._words.findall(s, at, m.start())] if m.start() > at else []
                words.append(-1 - self.added[m[0]])
                at = m.end()
            words += [number.setdefault(w, len(number)) for w in self._words.findall(s[at:] if at else s)]
            of.append(words)
        ids, sizes = self.merge([w.encode("utf-8", "replace") for w in number])
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        begins = (ends - sizes * 4).tolist()
        part = [raw[a:b] for a, b in zip(begins, ends.tolist(), strict=True)]
        return [b"".join([part[w] if w >= 0 else (-1 - w).to_bytes(4, "little") for w in words]) for words in of]

    def decode_ids(self, ids: np.ndarray) -> str:
        sizes = self._len[ids]
        total = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        return self._bytes[np.repeat(self._at[ids] - first, sizes) + np.arange(total)].tobytes().decode("utf-8", "replace")


def _kept(path: str) -> tuple[Bpe, Pieces]:
    def make() -> tuple[Bpe, Pieces]:
        bpe = Bpe(path)
        return bpe, Pieces(bpe.encode_strings)

    return held(("bpe", path), make)


def load(path: str) -> Bpe:
    return _kept(path)[0]


def coder(path: str) -> Pieces:
    """The pieces that were encoded, kept with the vocabulary's merges from task to task in a Python worker."""
    return _kept(path)[1]


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, and n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded.

    The new columns take the place of columns of these names.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_tokens", "ids", "decoded")
    out = T.StructType([f for f in docs.schema if f.name != text])
    out = out.add("n_tokens", T.LongType()).add("ids", T.BinaryType()).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = _kept(path)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids = pieces.encode_all([t or "" for t in texts])
            numbers = [np.frombuffer(x, dtype="<u4") for x in ids]
            rest = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array([len(x) for x in numbers], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode_ids(x) for x in numbers], pa.string())],
                names=[*rest, "n_tokens", "ids", "decoded"],
            )

    return docs.mapInArrow(run, out)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): one row a row of ``docs``."""
    done = round_trip(docs.select("doc_id", "text"), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

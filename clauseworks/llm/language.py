"""Language identification by cross-parsing entropy.

Of each language a bounded sample of labelled text is kept, as a suffix automaton. A text is parsed from left to
right into phrases, each the longest match found anywhere in the sample; the fewer phrases, the closer the text is
to that language. Phrases times the logarithm of the sample's length, by character, is the cross-parsing entropy;
the language with the least wins. The automata are walked in numpy, for blocks of many texts at a time; a phrase
ends where a block of ``BLOCK`` characters ends, in every language alike.

Letters are folded to lower case; a run of other characters counts as one space.

Defined cases: a null text, or one without letters, is ``und`` with score 0; equal entropies go to the language
that comes first; no labelled row at all makes every text ``und``; a null id is never held out and never learned
from; repeated rows are judged each; an empty table gives no rows; texts of any length are parsed whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseworks.llm.chunks import held, small_batches
from clauseworks.llm.common import column, drop_written, numbered, written

#: Characters learned from for each language, and for all together; texts that a language's may come from, and
#: characters of one text, at most. The automata, which every worker holds, grow with the second only.
SAMPLE_CHARS = 50_000
ALL_CHARS = 400_000
SAMPLE_TEXTS = 256
SAMPLE_TEXT_CHARS = 2_000
BLOCK = 1_024
UND = "und"
#: Bits a character up to which a text is in a language: such texts were seen to need 2 to 4.7, others 5.7 (code) to 16.
MOST_BITS = 5.5
SPREAD = 8.0
_PLANE = 0x10000


@lru_cache(1)
def _folded() -> np.ndarray:
    """Of each character up to U+FFFF the lower-case letter, or a space (code 32) if it is no letter."""
    fold = np.full(_PLANE, 32, dtype=np.uint16)
    for c in range(_PLANE):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            fold[c] = ord(low[0])
    return fold


def fold(text: str) -> np.ndarray:
    """Folded code points of ``text``; letters beyond U+FFFF become U+FFFF, which is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out = _folded()[np.minimum(points, _PLANE - 1)]
    for i in np.flatnonzero(points >= _PLANE):
        out[i] = _PLANE - 1 if chr(points[i]).isalpha() else 32
    space = out == 32
    return out[~(space & np.r_[False, space[:-1]])] if len(out) else out


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nxt


class Parser:
    """Counts phrases of many texts against all samples at once."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s})
        self._width = len(letters) + 1  # the last is any other letter
        code = {c: i for i, c in enumerate(letters)}
        self._code = np.full(_PLANE, len(letters), dtype=np.int64)
        for c, i in code.items():
            self._code[ord(c)] = i
        self._bits = np.array([math.log2(max(2, len(samples[x]))) for x in self.langs])
        tables, starts, at = [], [], 0
        for lang in self.langs:
            states = automaton(samples[lang])
            dead = len(states)  # after a letter that the sample lacks: whatever comes begins a phrase
            step = np.full((dead + 1, self._width), -1, dtype=np.int64)
            for i, moves in enumerate(states):
                for c, to in moves.items():
                    step[i, code[c]] = to
            fresh = np.where(step[0] < 0, dead, step[0])
            ends = step < 0
            ends[dead] = True
            to = np.where(ends, fresh[None, :], step)
            # a step holds the place of the next state's row, and in the lowest bit whether a phrase begins
            tables.append((((to * self._width + at) << 1) | ends).ravel())
            starts.append(dead * self._width + at)
            at += (dead + 1) * self._width
        self._table = np.concatenate(tables).astype(np.int64 if at >= 2**30 else np.int32) if tables else np.empty(0, np.int32)
        self._starts = np.array(starts, dtype=np.int64)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) phrases of folded texts."""
        k = len(self.langs)
        blocks = [(i, a, min(a + BLOCK, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), BLOCK)]
        total = np.zeros((len(texts), k), dtype=np.int64)
        if not blocks or not k:
            return total
        blocks.sort(key=lambda b: b[1] - b[2])
        lengths = np.array([b - a for _, a, b in blocks])
        codes = np.zeros((int(lengths[0]), len(blocks)), dtype=np.int32)
        for j, (i, a, b) in enumerate(blocks):
            codes[: b - a, j] = self._code[texts[i][a:b]]
        active = np.searchsorted(-lengths, -np.arange(len(codes)), side="left")  # blocks longer than each place
        state = np.repeat(self._starts[:, None], len(blocks), axis=1).astype(np.int32 if self._table.dtype == np.int32 else np.int64)
        count = np.zeros((k, len(blocks)), dtype=np.int32)
        for row, n in zip(codes, active, strict=True):
            step = self._table[state[:, :n] + row[:n]]
            count[:, :n] += step & 1
            state[:, :n] = step >> 1
        np.add.at(total, [i for i, _, _ in blocks], count.T)
        return total

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        langs, scores, bits = [UND] * len(texts), [0.0] * len(texts), [float("inf")] * len(texts)
        if not self.langs:
            return langs, scores, bits
        size, todo = 0, []
        folded: list[np.ndarray] = []

        def some() -> None:
            counts = self.phrases(folded)
            for i, f, c in zip(todo, folded, counts, strict=True):
                entropy = c * self._bits / len(f)
                best = int(np.argmin(entropy))
                langs[i], bits[i] = self.langs[best], float(entropy[best])
                scores[i] = float(1 / np.exp(SPREAD * (entropy[best] - entropy)).sum())

        for i, text in enumerate(texts):
            f = fold(text) if text else np.empty(0, np.uint16)
            if not (f != 32).any():
                continue
            todo.append(i)
            folded.append(f)
            size += len(f)
            if size >= 4_000 * BLOCK:
                some()
                size, todo, folded = 0, [], []
        some()
        return langs, scores, bits


def parser(samples: dict[str, str]) -> Parser:
    """The parser of these samples, built once in a Python worker."""
    return held(hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest(), lambda: Parser(samples))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> dict[str, str]:
    """A folded sample of each language in ``docs`` (text, lang).

    Texts are dealt out by hash to SAMPLE_TEXTS places a language; the least hash of each place is taken, so that
    copies count once and no language's rows meet in one task. The second pass looks its rows up in the table of
    those hashes, which is written so that its size decides how it is joined; no text is shuffled.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, SAMPLE_TEXT_CHARS).alias("part"))
    least = known.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("place")).agg(F.min("h").alias("h"))
    least = written(least.select("lang", "h"), "language-texts")
    each = min(SAMPLE_CHARS, ALL_CHARS // max(1, least.select("lang").distinct().count()))
    taken = known.join(least, ["lang", "h"], "left_semi").distinct()
    samples: dict[str, str] = {}
    for row in taken.orderBy("lang", "h", "part").toLocalIterator():
        now = samples.get(row["lang"], "")
        if len(now) < each:
            samples[row["lang"]] = (now + fold(row["part"]).tobytes().decode("utf-16-le", "ignore") + " ")[:each]
    drop_written(least)
    return {k: v for k, v in samples.items() if v.strip()}


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` and lang_pred, score and bits (a character, in that language), which take the place of columns of these names."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(samples)  # ALL_CHARS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = parser(shared.value).judge
        for batch in batches:
            langs, scores, bits = judge(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score", "bits"],
            )

    rest = docs.drop("lang_pred", "score", "bits")
    return rest.mapInArrow(run, T.StructType([*rest.schema]).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("bits", T.DoubleType()))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the documents that are not held out, judges all."""
    samples = learn(docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).select("text", "lang"))
    judged = identify(docs.select("doc_id", "text"), samples)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, wanted: tuple[str, ...] | None = None, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages (of those ``wanted``, if given), with its columns.

    A text is in none where even the language that parses it best needs more than ``most_bits`` a character: its
    phrases are short, as any two scripts or languages share a few letters in a row. Texts without letters are in
    none, either. Where no sample is there to judge by, those with letters stay.
    """
    samples = learn(docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).select("text", "lang"))
    if not samples:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    # columns of any name pass through
    kept = numbered(docs.columns)
    renamed = docs.select(*[column(c).alias(k) for c, k in zip(docs.columns, kept, strict=True)])
    told = identify(renamed, samples, kept[docs.columns.index("text")]).where((F.col("lang_pred") != UND) & (F.col("bits") <= most_bits))
    if wanted is not None:
        told = told.where(F.col("lang_pred").isin(*wanted))
    return told.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, kept, strict=True)])

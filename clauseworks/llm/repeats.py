"""Removal of long repeats: every byte that lies in a string of ``length`` bytes which starts anywhere else, too.

A string of that length is a *window*. Equal windows must meet, and no task can take them all, so each window goes
where its contents say: by the least hash of its 32-byte strings. Successive windows mostly share that value,
and such a run of windows travels as one *piece* of text. Pieces of one value are then the whole problem, in small:
their suffix arrays (``suffix_arrays.py``: grouping by Lyndon prefixes) have equal windows side by side.

1. Equal texts become one row with a count, in a table that is bucketed by the text's key: texts are shuffled once.
2. Each text gives the values of its runs, 24 bytes a run; values met only once are dropped, as nothing can repeat
   there. Hot values are dealt out.
3. Of the pieces of the other values, equal ones become one row with a count. Where all pieces of a value are equal,
   their number settles it. Else they are cut out of one text each, and get a suffix array for each value, many values
   at a time.
4. Where the different pieces of a value exceed ``WIDE`` bytes (a passage that very many texts go on from differently),
   they are dealt out to blocks, each with its suffix array. A block says which windows it has, one row for all that
   are equal; those that another block has, too, are found by a 128-bit hash of the window.
5. The windows found go back to their texts, which stayed where they are, and the bytes are cut out.

Defined cases: null is the empty text; a text below ``length`` keeps all; of texts that are equal, repeated rows
included, all bytes go where they have ``length``; overlaps within one text count; texts of any length are worked off
in slices; a null ``doc_id`` is a document as any other; no documents give no rows; only the columns named are read.
Equal texts and equal pieces are told by 128 bits of SHA-256 and MD5, hashes of shorter strings only deal out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm.chunks import small_batches
from clauseworks.llm.common import drop_since, drop_written, new_path, spread_join, written, written_so_far
from clauseworks.llm.suffix_arrays import suffix_arrays

LENGTH = 200
#: Windows of a piece at most, and of a text that are hashed at a time.
PIECE = 4096
SLICE = 32 * PIECE
#: Bytes of different pieces of one value that one suffix array takes at most, and bytes that are sorted at a time.
WIDE = 16_384
BATCH = 2_000_000

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x + np.uint64(seed)) * _MIX[0]
    x ^= x >> np.uint64(31)
    x *= _MIX[1]
    x ^= x >> np.uint64(29)
    x *= _MIX[2]
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,)).copy()


def gram_of(length: int) -> int:
    """Bytes of the strings by which windows meet: the longer, the fewer windows meet by chance."""
    return 32 if length >= 64 else 16 if length >= 32 else 8


def least_hashes(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``data`` the least hash of its grams, and the hashes of all grams."""
    grams, size, gram = _words(data) * _MIX[0], 8, gram_of(length)
    while size < gram:
        grams ^= grams >> np.uint64(29)
        grams = grams[:-size] * _MIX[1] + grams[size:]
        size *= 2
    grams ^= grams >> np.uint64(32)
    grams *= _MIX[2]
    grams ^= grams >> np.uint64(29)
    width = length - gram + 1
    pad = -len(grams) % width
    table = np.r_[grams, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(grams) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]), grams


def _ramps(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _slices(texts: list, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least ``length`` bytes, joined to about SLICE bytes: (bytes, text of each part, where it begins in the text, in the bytes, its windows)."""
    parts: list[tuple[int, int, int]] = []
    size = 0

    def joined() -> tuple:
        which, at, n = (np.array(c, np.int64) for c in zip(*parts, strict=True))
        data = np.frombuffer(b"".join(texts[i][a : a + k] for i, a, k in parts), np.uint8)
        return data, which, at, np.cumsum(n) - n, n - length + 1

    for i, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, SLICE):
            n = min(len(text) - a, SLICE + length - 1)
            parts.append((i, a, n))
            size += n
            if size >= SLICE:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def runs(texts: list, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, number of windows, value, whether the value's gram is there more than once) of the runs of many texts, some at a time."""
    width = length - gram_of(length) + 1
    for data, which, at, begin, n in _slices(texts, length):
        least, grams = least_hashes(data, length)
        place = _ramps(begin, n)  # of the windows that lie in one text
        of = np.repeat(np.arange(len(n)), n)
        value = least[place]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]] | ((place - begin[of]) % PIECE == 0))
        count = np.diff(np.r_[first, len(place)])
        span = count + width - 1
        same = grams[_ramps(place[first], span)] == np.repeat(value[first], span)
        often = np.add.reduceat(same.astype(np.int64), np.cumsum(span) - span) > 1
        of = of[first]
        yield which[of], place[first] - begin[of] + at[of], count, value[first].view(np.int64), often


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, compressed bytes and length of texts: less than half is shuffled and written."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [t.as_py() for t in batch.column("data")]
        columns = [pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()), pa.array(map(pack, texts), pa.binary()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "data", "n_bytes"])


def _texts_of(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t.as_py()) for t in batch.column("data")]


_RUNS = "key binary, value bigint, start bigint, size int"


def _runs_of_texts(length: int):
    """All runs; one that has its value's gram twice comes as two, so that its value counts as met again."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, start, count, value, often in runs(_texts_of(batch), length):
                which, value, start, size = (np.r_[x, x[often]] for x in (which, value, start, count + length - 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(which)), pa.array(value), pa.array(start), pa.array(size.astype(np.int32))], names=["key", "value", "start", "size"]
                )

    return found


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The MD5 of the pieces of runs."""
    for batch in batches:
        rows = []
        for key, data, wanted in zip(batch.column("key").to_pylist(), _texts_of(batch), batch.column("runs").to_pylist(), strict=True):
            for r in {(r["start"], r["size"], r["value"]) for r in wanted}:
                rows.append((key, *r, hashlib.md5(data[r[0] : r[0] + r[1]], usedforsecurity=False).digest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "start", "size", "value", "name"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of pieces."""
    for batch in batches:
        rows = []
        for data, pieces in zip(_texts_of(batch), batch.column("pieces").to_pylist(), strict=True):
            rows += [(p["name"], p["value"], data[p["start"] : p["start"] + p["size"]], p["count"], p["blocks"]) for p in pieces]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "value", "piece", "count", "blocks"])


Group = list[tuple[bytes, bytes, int]]
_SPANS = "name binary, a array<int>, b array<int>, h1 array<bigint>, h2 array<bigint>, at array<int>"


def ordered_windows(groups: list[Group], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The windows of pieces (name, bytes, count), in the order of their group's suffix array: (piece, start in it, place in the joined bytes, class of equal windows), and how often each class is there."""
    pieces = [p for g in groups for p in g]
    sizes = np.array([len(p) for _, p, _ in pieces])
    data = _joined(groups)
    # each piece is followed by a mark, a group's last by its end: symbols 1 and 0
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    which = np.repeat(np.arange(len(pieces)), sizes)
    symbols = np.ones(len(which) + len(pieces), np.int64)
    symbols[np.arange(len(which)) + which] = data[: len(which)].astype(np.int64) + 2
    last = np.cumsum([len(g) for g in groups]) - 1
    symbols[(starts + sizes)[last]] = 0
    order = suffix_arrays(symbols, np.r_[0, (starts + sizes)[last] + 1])
    # of the suffixes, those that begin a window; among these, equal windows are neighbours
    piece_of = np.repeat(np.arange(len(pieces)), sizes + 1)[order]
    inside = order - starts[piece_of]
    whole = inside <= sizes[piece_of] - length
    piece_of, inside = piece_of[whole], inside[whole]
    at = (order[whole] - piece_of).astype(np.int64)  # in data, which has no marks
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[piece_of]
    words = _words(data)
    same = np.flatnonzero(group_of[1:] == group_of[:-1])
    for k in [*range(0, length - 8, 8), length - 8]:
        same = same[words[at[same] + k] == words[at[same + 1] + k]]
    joined = np.zeros(len(at), bool)
    joined[same + 1] = True
    kind = np.cumsum(~joined) - 1
    return piece_of, inside, at, kind, np.bincount(kind, np.array([c for *_, c in pieces])[piece_of])


def _joined(groups: list[Group]) -> np.ndarray:
    return np.frombuffer(b"".join(p for g in groups for _, p, _ in g) + bytes(8), np.uint8)


def _by_piece(piece_of: np.ndarray, *columns: np.ndarray) -> dict[int, list[np.ndarray]]:
    order = np.argsort(piece_of, kind="stable")
    of = piece_of[order]
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    parts = [np.split(c[order], cut[1:]) for c in columns]
    return {int(of[c]): [p[i] for p in parts] for i, c in enumerate(cut)}


def spans(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Ascending numbers as ranges [a, b)."""
    new = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1] + 1])
    return starts[new].tolist(), (starts[np.r_[new[1:] - 1, len(starts) - 1]] + 1).tolist()


def _search(length: int):
    def solved(groups: list[Group], shared: bool) -> pa.RecordBatch:
        """``shared``: the groups are blocks of larger ones, so they say what else must be looked for in other blocks, too."""
        names = [p[0] for g in groups for p in g]
        piece_of, inside, at, kind, often = ordered_windows(groups, length)
        hit = often[kind] > 1
        found = _by_piece(piece_of[hit], inside[hit])
        asked: dict[int, list[np.ndarray]] = {}
        if shared:
            # one of each class; of what is met once, where it is, as another block may have it
            one = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.empty(0, bool)
            h1, h2 = (h[at[one]] for h in window_hashes(_joined(groups), length))
            asked = _by_piece(piece_of[one], h1, h2, np.where(hit[one], -1, inside[one]))
        rows = []
        for i in sorted({*found, *asked}):
            a, b = spans(np.sort(found[i][0])) if i in found else ([], [])
            rows.append((names[i], a, b, *([c.tolist() for c in asked[i]] if i in asked else ([], [], []))))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = [pa.binary(), ints, ints, longs, longs, ints]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "a", "b", "h1", "h2", "at"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # groups of about one size are sorted together; a group ends where value or block change
        waiting: dict[tuple[int, bool], list[Group]] = defaultdict(list)
        bytes_of: dict[tuple[int, bool], int] = defaultdict(int)
        now: tuple | None = None
        group: Group = []

        def ready() -> list[pa.RecordBatch]:
            size = sum(len(p) for _, p, _ in group)
            kind = (size.bit_length(), now[2] > 1)
            waiting[kind].append(group)
            bytes_of[kind] += size
            if bytes_of[kind] < BATCH:
                return []
            bytes_of[kind] = 0
            return [solved(waiting.pop(kind), kind[1])]

        for batch in batches:
            for value, block, blocks, *row in zip(*(batch.column(c).to_pylist() for c in ("value", "block", "blocks", "name", "piece", "count")), strict=True):
                if (value, block, blocks) != now and group:
                    yield from ready()
                    group = []
                now = (value, block, blocks)
                group.append(tuple(row))
        if group:
            yield from ready()
        for (_, shared), groups in waiting.items():
            yield solved(groups, shared)

    return search


def window_hashes(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window, by hashes of strings of 8, 16, 32 … bytes, each of two halves, and of the parts that make up the length."""
    out = []
    for seed in (1, 2):
        part = {8: _mix(_words(data), seed)}
        while (n := max(part)) * 2 <= length:
            part[2 * n] = _mix(_mix(part[n][:-n], seed) + part[n][n:], seed + n)
        n = len(data) - length + 1
        whole, at = np.zeros(n, np.uint64), 0
        for size in sorted(part, reverse=True):
            while at + size <= length:
                whole = _mix(_mix(whole, seed) + part[size][at : at + n], seed)
                at += size
        whole = whole if at == length else _mix(_mix(whole, seed) + part[8][length - 8 : length - 8 + n], seed)
        out.append(whole.view(np.int64))
    return out[0], out[1]


def _removed(length: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, data, found in zip(batch.column("key"), _texts_of(batch), batch.column("found"), strict=True):
                begin = np.concatenate([np.array(f["a"], np.int64) + f["start"] for f in found.as_py()])
                end = np.concatenate([np.array(f["b"], np.int64) + f["start"] for f in found.as_py()]) + length - 1
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
                begin, end = begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]
                left = hashlib.sha256()
                for a, b in zip(np.r_[0, end].tolist(), np.r_[begin, len(data)].tolist(), strict=True):
                    left.update(data[a:b])
                out.append((key.as_py(), int((end - begin).sum()), len(begin), left.hexdigest()))
            keys, gone, n, sha = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256"])

    return removed


class _Texts:
    """The different texts (key, data, n_bytes, n) as a table bucketed by key, in the shared folder, so that joins on the key leave them in place."""

    def __init__(self, rows: DataFrame):
        self._spark: SparkSession = rows.sparkSession
        parts = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        self._name, self._path = f"texts_{uuid.uuid4().hex}", new_path(self._spark, "texts")
        once = rows.groupBy("key").agg(F.first("data").alias("data"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        once.write.bucketBy(parts, "key").format("parquet").option("path", self._path).saveAsTable(self._name)
        self.table = self._spark.table(self._name)

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE {self._name}")
        at = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        at.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(at, True)


def _across_blocks(found: DataFrame) -> DataFrame:
    """(name, a, b) of windows that are there once in a block, and in another block of their value."""
    asked = found.where(F.size("h1") > 0).select("name", F.explode(F.arrays_zip("h1", "h2", "at")).alias("w")).select("name", "w.*")
    twice = written(asked.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated-windows")
    starts = asked.where("at >= 0").join(twice, ["h1", "h2"], "left_semi").groupBy("name").agg(F.array_sort(F.collect_list("at")).alias("a"))  # at most PIECE of them
    return starts.select("name", "a", F.transform("a", lambda x: x + 1).alias("b"))


def _spans_of_pieces(names: DataFrame, texts: DataFrame, length: int, wide: int) -> DataFrame:
    """(name, a, b) of different pieces (name, value, key, start, size, count): windows from a to b of a piece are elsewhere, too."""
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = names.groupBy("value").agg(F.count("*").alias("different"), F.sum("size").alias("bytes"))
    names = written(spread_join(names, sizes, "value", ["name"]), "names")
    # a value whose pieces are all equal is settled by their number
    settled = (F.col("different") == 1) & (F.col("count") > 1)
    equal = names.where(settled).select("name", F.array(F.lit(0)).alias("a"), F.array((F.col("size") - F.lit(length - 1)).cast("int")).alias("b"))
    blocks = F.when(F.col("bytes") > wide, F.ceil(F.col("bytes") / F.lit(max(1, wide) / 2.0))).otherwise(F.lit(1)).cast("long")
    rest = names.where(~settled).withColumn("blocks", blocks)
    rest = rest.groupBy("key").agg(F.collect_list(F.struct("name", "start", "size", "value", "count", "blocks")).alias("pieces"))
    cut = texts.join(rest, "key").select("data", "pieces").mapInArrow(_cut, "name binary, value bigint, piece binary, count bigint, blocks bigint")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
    dealt = cut.repartition(parts, "value", "block").sortWithinPartitions("value", "block")
    found = written(dealt.mapInArrow(_search(length), _SPANS), "ordered")
    near = found.where(F.size("a") > 0).select("name", "a", "b")
    return equal.unionByName(near).unionByName(_across_blocks(found))


def without_repeats(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each of (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    mark = written_so_far()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    long = docs.select(text.cast("binary").alias("data")).where(F.octet_length("data") >= length)
    texts = _Texts(long.mapInArrow(_packed, "key binary, data binary, n_bytes bigint"))
    met = written(texts.table.select("key", "data").mapInArrow(_runs_of_texts(length), _RUNS), "values")
    often = written(met.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value", F.lit(True).alias("hit")), "repeated-values")
    wanted = spread_join(met, often, "value", ["key"]).where("hit").groupBy("key").agg(F.collect_list(F.struct("value", "start", "size")).alias("runs"))
    found = texts.table.join(wanted, "key").select("key", "data", "runs")
    runs_of = written(found.mapInArrow(_named, "key binary, start bigint, size bigint, value bigint, name binary"), "runs")
    drop_written(met, often)
    # equal pieces are cut out of one text only
    one = runs_of.groupBy("name").agg(F.min(F.struct("key", "start", "size", "value")).alias("p"), F.count("*").alias("count"))
    names = written(one.select("name", "p.*", "count"), "pieces")
    found = written(_spans_of_pieces(names, texts.table, length, wide), "spans")
    places = spread_join(runs_of.select("name", "key", "start"), found, "name", ["key", "start"]).where(F.col("a").isNotNull())
    by_text = places.groupBy("key").agg(F.collect_list(F.struct("start", "a", "b")).alias("found"))
    some = texts.table.where("n = 1").join(by_text, "key").select("key", "data", "found")
    cut_out = some.mapInArrow(_removed(length), "key binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    whole = texts.table.where("n > 1").select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    result = written(cut_out.unionByName(whole), "repeats")
    drop_since(spark, mark, result)
    texts.drop()
    out = spread_join(rows.select("doc_id", "key", "sha", "n_bytes"), result, "key", ["doc_id"])
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )

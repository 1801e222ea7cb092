"""N-gram Jaccard join by grouped prefixes: which documents share 80 of 100 five-word shingles.

1. Texts with the same shingle set are one node. A sketch of fixed size counts how common shingles are.
2. A node's shingles are put in one order for all, common ones last. Two sets of that similarity share a shingle
   among the first n - ceil(0.8 n) + 1 of each: the prefix. Nodes of equal size and prefix are one group, and only
   groups, not documents, enter the lists of who has which prefix shingle.
3. In every list each group is paired with the list's first of like size: as many pairs as entries. Pairs that size
   and place in the order still allow are expanded to members and verified on the whole sets; the links make
   components.
4. All other pairs in a list are candidates as well, but those inside one component add nothing. So only pairs of
   groups in different components are filtered, expanded and verified, and then nothing is missing. Lists above
   ``LIST`` entries are dealt out in pairs of blocks.

Every pair is verified on its whole sets of 64-bit hashes: two different shingles of a pair of sets share one with a
chance of 1 in 10**12 for sets of 4,000, which then moves the count of shared ones by one. Sets are told apart by 128
bits: a node's id has 64 of them, and where the others differ (some three times among 10**10 texts) both go in.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; repeated rows are
documents of one node; documents of one id are told apart by their text; a null id counts as greater than any other
and stands alone as null; an empty table gives an empty result; a text of any length has its
whole set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.llm.chunks import small_batches
from clauseworks.llm.common import drop_written, fresh, spread_join, written
from clauseworks.llm.components import components
from clauseworks.llm.shingles import set_ids, shingle_sets

#: Similarity of a link, as the fraction SHARED / 100.
SHARED = 80
#: Buckets of the sketch, by the hash's first bits, and its parts; entries of a list that one task pairs at most.
BUCKET_BITS = 22
PARTS = 64
LIST = 5_000
#: Orders in which a list's first group is chosen.
LEADERS = 16
#: Entries before each in a list that it is paired with at once.
BEFORE = 3
#: Bits of the filter that says which nodes are in a candidate pair, at most: eight megabytes.
FILTER_BITS = 1 << 26
#: Bits of a set's parity map, at most; entries of a list up to which lists of one length are paired together.
PARITY_BITS = 1 << 16
SHORT_LIST = 64
_U = np.uint64


def _least_overlap(n: np.ndarray | int):
    """The least intersection with any set that a set of n links with."""
    return -(-n * SHARED // 100)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SHARED * (len(a) + len(b) - both)


def _parity(s: np.ndarray) -> bytes:
    """Of each residue of the hashes, whether an odd number of them has it: a bit map about as long as twice the set."""
    bits = min(max(256, 1 << int(2 * len(s) - 1).bit_length()), PARITY_BITS)
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """At most the size of the symmetric difference of the sets with these parities."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _most_different(n):
    """The greatest symmetric difference of sets that link and have ``n`` members between them."""
    return n - 2 * -(-SHARED * n // (100 + SHARED))


def _possible(n1, p1, n2, p2):
    """Whether sets of these sizes, which share the shingle at these places, can still link."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    need = -(-SHARED * (n1 + n2) // (100 + SHARED))
    return (100 * small >= SHARED * large) & (np.minimum(n1 - p1, n2 - p2) >= need)


class _Seen:
    """Nodes that a task has met, up to a bound: what is met again is only work saved."""

    def __init__(self, most: int = 200_000):
        self._met: set[tuple[int, int]] = set()
        self._most = most

    def first(self, x: tuple[int, int]) -> bool:
        if x in self._met:
            return False
        if len(self._met) >= self._most:
            self._met.clear()
        self._met.add(x)
        return True


def _batch(names: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in names.values()], names=list(names))


def _sketch_and_nodes(docs: DataFrame) -> DataFrame:
    """doc rows (doc_id, text_key, n, node, check), and rows of the sketch (part, counts): which is which by ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        seen, held, size = _Seen(), [], 0

        def count() -> None:
            nonlocal counts
            if held:
                counts += np.bincount((np.concatenate(held) >> _U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
                held.clear()

        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist())
            ids = [set_ids(s) if len(s) else (None, None) for s in sets]
            for s, x in zip(sets, ids, strict=True):
                if len(s) and seen.first(x):
                    held.append(s)
                    size += len(s)
            if size > 4_000_000:
                count()
                size = 0
            k = len(sets)
            yield _batch(
                {
                    "doc_id": (batch.column("doc_id"), pa.int64()), "text_key": (batch.column("text_key"), pa.int64()),
                    "n": ([len(s) for s in sets], pa.int64()), "node": ([x for x, _ in ids], pa.int64()), "check": ([y for _, y in ids], pa.int64()),
                    "part": ([None] * k, pa.int32()), "counts": ([None] * k, pa.binary()),
                }
            )
        count()
        if counts.any():
            parts = np.minimum(counts, 255).astype(np.uint8).reshape(PARTS, -1)
            none = [None] * PARTS
            yield _batch(
                {
                    "doc_id": (none, pa.int64()), "text_key": (none, pa.int64()), "n": (none, pa.int64()), "node": (none, pa.int64()), "check": (none, pa.int64()),
                    "part": (range(PARTS), pa.int32()), "counts": ([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
                }
            )

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key long, n long, node long, check long, part int, counts binary")


def _ranks(sketch: DataFrame) -> np.ndarray:
    """How common each bucket's shingles are, in a byte: 0 for all that do not stand out. Of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                raw = zlib.decompress(raw)
                wide = np.frombuffer(raw, dtype=np.uint8 if len(raw) == (1 << BUCKET_BITS) // PARTS else "<i4").astype(np.int64)
                sums[part] = sums[part] + wide if part in sums else wide
        for part, x in sums.items():
            yield _batch({"part": ([part], pa.int32()), "counts": ([zlib.compress(np.minimum(x, 2**31 - 1).astype("<i4").tobytes(), 1)], pa.binary())})

    schema = "part int, counts binary"
    # each task first adds up what it reads, then one task has what remains of a part
    summed = sketch.select("part", "counts").mapInArrow(add, schema).repartition(PARTS, "part").mapInArrow(add, schema)
    counts = np.zeros((PARTS, (1 << BUCKET_BITS) // PARTS), dtype=np.int64)
    for row in summed.toLocalIterator():
        counts[row["part"]] += np.frombuffer(zlib.decompress(row["counts"]), dtype="<i4")
    counts = counts.ravel()
    usual = counts.mean() + 6 * np.sqrt(counts.mean()) + 1
    over = np.maximum(counts - usual, 0)
    return np.where(over > 0, np.minimum(255, 1 + np.floor(4 * np.log2(1 + over))), 0).astype(np.uint8)


def _prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(node, check, n, gid, parity, prefix) of each node; one that several tasks meet comes several times.

    ``gid`` has 64 bits of size and prefix: groups that share one are expanded and verified together, which loses nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 2**BUCKET_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, _Seen()
        for batch in batches:
            nodes, checks, sizes, gids, parities, prefixes = [], [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                if not len(s) or not seen.first(ids := set_ids(s)):
                    continue
                n = len(s)
                keys = (rank[(s >> _U(64 - BUCKET_BITS)).astype(np.int64)].astype(_U) << _U(56)) | (s >> _U(8))
                most = n - _least_overlap(n) + 1
                prefix = np.sort(np.partition(keys, most - 1)[:most] if most < n else keys)
                nodes.append(ids[0])
                checks.append(ids[1])
                sizes.append(n)
                gids.append(set_ids(np.r_[_U(n), prefix])[0])
                parities.append(_parity(s))
                prefixes.append(prefix.astype(np.int64, casting="unsafe"))
            offsets = np.cumsum([0, *map(len, prefixes)])
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int64()) for x in (nodes, checks, sizes, gids)], pa.array(parities, pa.binary()), lists], names=["node", "check", "n", "gid", "parity", "prefix"]
            )

    return docs.select("text").mapInArrow(run, "node long, check long, n long, gid long, parity binary, prefix array<long>")


def _told_apart(rows: DataFrame, clashes: list[int]) -> DataFrame:
    """``rows`` with a node for each of two sets whose first 64 bits are equal."""
    if not clashes:
        return rows
    return rows.withColumn("node", F.when(F.col("node").isin(clashes), F.col("node").bitwiseXOR("check")).otherwise(F.col("node")))


def _lists(prefixes: DataFrame) -> DataFrame:
    """Entries (key, gid, n, place) of lists of two groups or more, each with the groups to be paired with.

    These are the first of like size in the list, the first of those a step smaller, and the BEFORE before it: a
    number of pairs in proportion to the entries.

    Rows come to a task sorted by key, and are read as a stream.
    """
    entries = prefixes.select("gid", "n", F.posexplode("prefix").alias("place", "key"))
    # sizes in steps of the similarity: groups more than a step apart can't link
    entries = entries.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / SHARED))).cast("int"))
    # Which group comes first differs from list to list, in LEADERS ways: near copies of one text are often closer
    # to that text than to each other, and so each is compared with several before all pairs are looked at.
    entries = entries.withColumn("turn", F.xxhash64("gid", F.pmod("key", F.lit(LEADERS))))
    spread = entries.repartition("key").sortWithinPartitions("key", "step", "turn", "gid").drop("turn")
    kinds = {"key": pa.int64(), "gid": pa.int64(), "n": pa.int64(), "place": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the last entry: it may go with the next batch
        many_before = False  # whether entries of its list came before it
        firsts: list[np.ndarray] = []  # of its run, and of the run a step below: [gid, n, place, whether there is one]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*kinds, "step")}
            if held is not None:
                x = {c: np.r_[held[c], v] for c, v in x.items()}
            new = np.r_[True, (x["key"][1:] != x["key"][:-1]) | (x["gid"][1:] != x["gid"][:-1])]
            x = {c: v[new] for c, v in x.items()}  # a group that came several times
            same = x["key"][1:] == x["key"][:-1]
            run_begins = np.flatnonzero(np.r_[True, ~same | (x["step"][1:] != x["step"][:-1])])
            of_run = np.searchsorted(run_begins, np.arange(len(x["key"])), side="right") - 1
            own = np.stack([x["gid"][run_begins], x["n"][run_begins], x["place"][run_begins], np.ones(len(run_begins), np.int64)])
            if firsts:
                own[:, 0] = firsts[0]  # the held entry's run began before
            below = np.zeros_like(own)
            k, step = x["key"][run_begins], x["step"][run_begins]
            near = (k[1:] == k[:-1]) & (step[1:] == step[:-1] + 1)
            below[:, 1:] = own[:, :-1] * near
            if firsts:
                below[:, 0] = firsts[1]
            many = np.zeros(len(x["key"]), dtype=bool)
            many[1:] |= same
            many[:-1] |= same
            many[0] |= many_before
            many_before, firsts = bool(many[-1]), [own[:, -1].copy(), below[:, -1].copy()]
            held = {c: v[-1:] for c, v in x.items()}
            keep = np.flatnonzero(many[:-1])
            if len(keep):
                earlier = []
                for back in range(1, BEFORE + 1):
                    at = np.maximum(keep - back, 0)
                    there = (keep >= back) & (x["key"][at] == x["key"][keep])
                    earlier.append(np.stack([x["gid"][at], x["n"][at], x["place"][at], there.astype(np.int64)]))
                yield _entries({c: v[keep] for c, v in x.items()}, own[:, of_run[keep]], below[:, of_run[keep]], *earlier)
        if held is not None and many_before:
            yield _entries(held, firsts[0][:, None], firsts[1][:, None])

    def _entries(x: dict[str, np.ndarray], *others: np.ndarray) -> pa.RecordBatch:
        gid, n, place, there = np.stack(others, axis=2)
        ok = (there > 0) & (gid != x["gid"][:, None]) & _possible(x["n"][:, None], x["place"][:, None], n, place)
        offsets = np.r_[0, np.cumsum(ok.sum(axis=1))]
        others_of = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(gid[ok], pa.int64()))
        return pa.RecordBatch.from_arrays([*[pa.array(x[c]) for c in kinds], others_of], names=[*kinds, "others"])

    return spread.mapInArrow(run, "key long, gid long, n long, place long, others array<long>")



def _likely(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose parities still allow a link, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = _most_different(batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy())
            x, y = batch.column("p_a").to_pylist(), batch.column("p_b").to_pylist()
            ok = pa.array([_differ(i, j) <= m for i, j, m in zip(x, y, most.tolist(), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    of = [members.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}")) for c in "ab"]
    both = pairs.join(of[0], "a").join(of[1], "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
    return written(both.mapInArrow(run, "a long, b long"), "pairs")


def _verified(docs: DataFrame, pairs: DataFrame, clashes: list[int]) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose whole sets link, as a written table."""
    spark = docs.sparkSession
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # which nodes are wanted, as a bit map of fixed size at most: it spares sending the sets of all others
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * pairs.count()).bit_length()))
    spots = nodes.select(F.pmod("node", F.lit(bits)).alias("spot"))
    words = spots.groupBy((F.col("spot") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(spot, 64) as int)))").alias("bits"))
    wanted = np.zeros(bits // 64, dtype=np.int64)
    for row in words.toLocalIterator():
        wanted[row["w"]] = row["bits"]
    shared = spark.sparkContext.broadcast((wanted, frozenset(clashes)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (want, same), seen = shared.value, _Seen()
        for batch in batches:
            nodes, found = [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                if not len(s):
                    continue
                ids = set_ids(s)
                node = ids[0] ^ ids[1] if ids[0] in same else ids[0]
                spot = node % bits
                if int(want[spot // 64]) >> (spot % 64) & 1 and seen.first(ids):
                    nodes.append(node)
                    found.append(s.astype("<u8").tobytes())
            yield _batch({"node": (nodes, pa.int64()), "shingles": (found, pa.binary())})

    whole = docs.select("text").mapInArrow(sets, "node long, shingles binary").join(nodes, "node", "left_semi")
    whole = written(whole.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    a = whole.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = whole.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, dtype="<u8") for v in batch.column(c).to_pylist()] for c in ("of_a", "of_b"))
            ok = pa.array([_linked(i, j) for i, j in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    links = written(pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long"), "links")
    drop_written(whole)
    return links


def _streamed(rows: DataFrame, keys: list[str], columns: list[str], pairs_of, schema: str, binary: tuple[str, ...] = ()) -> DataFrame:
    """``pairs_of`` (columns, edges) of all lists of ``rows``, each list whole: a stream sorted by ``keys`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            x = {c: v if c in binary else v.astype(np.int64) for c, v in x.items()}
            if held is not None:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
            differs = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in keys])
            cut = np.flatnonzero(differs) + 1
            if len(cut):
                yield from pairs_of(x, np.r_[0, cut])
            held = {c: v[cut[-1] if len(cut) else 0 :] for c, v in x.items()}
        if held is not None:
            yield from pairs_of(held, np.array([0, len(held[keys[0]])]))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "root").select(*columns).mapInArrow(run, schema)


def _short(x: dict[str, np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of units (gid, root) of different roots in short lists: lists of one length together."""
    begins, sizes = edges[:-1], np.diff(edges)
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(m, 1)
        at = begins[sizes == m]
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(at), step):
            a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            ok = (x["root"][a] != x["root"][b]) & _possible(x["n"][a], x["place"][a], x["n"][b], x["place"][b])
            a, b = a[ok], b[ok]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x[c][k]) for k in (a, b) for c in ("gid", "root")], names=["gid_a", "root_a", "gid_b", "root_b"])


def _fold(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _long(x: dict[str, np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different roots in long lists, or two blocks of one, whose parities allow a link."""
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        root, n, place, node, block = (x[c][begin:end] for c in ("root", "n", "place", "node", "block"))
        apart = x["lo"][begin] != x["hi"][begin]
        words = np.array([len(p) // 8 for p in x["parity"][begin:end]])
        maps = {w: np.frombuffer(b"".join(x["parity"][begin:end][words == w]), dtype=np.uint64).reshape(-1, w) for w in np.unique(words).tolist()}
        row = np.zeros(end - begin, dtype=np.int64)
        for w in maps:
            row[words == w] = np.arange(len(maps[w]))
        after = np.searchsorted(root, root, side="right")  # a root's entries stand together
        mine, theirs = [], []
        for i in range(end - begin):
            ok = _possible(n[i], place[i], n[after[i] :], place[after[i] :])
            if apart:
                ok &= block[after[i] :] != block[i]
            found = np.flatnonzero(ok) + after[i]
            for w in np.unique(words[found]).tolist():
                some = found[words[found] == w]
                least = min(w, int(words[i]))
                far = np.bitwise_count(_fold(maps[w][row[some]], least) ^ _fold(maps[int(words[i])][row[i] : row[i] + 1], least)).sum(axis=1)
                some = some[far <= _most_different(n[some] + n[i])]
                mine.append(np.full(len(some), node[i]))
                theirs.append(node[some])
        if mine and len(a := np.concatenate(mine)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(theirs))], names=["a", "b"])


def _between(lists: DataFrame, rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written table, and what reads it: pairs (a, b) of nodes in different components that share a key and can still link.

    ``lists`` (key, gid, n, place); ``rooted`` (gid, node, root, parity). Short lists are paired by unit (gid and
    root), and then expanded; long ones by node, with the parities beside them.
    """
    units = rooted.select("gid", "root").distinct()
    lists = lists.join(units, "gid")
    # only lists with more than one component are of interest
    many = lists.groupBy("key").agg(F.count("*").alias("entries"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    many = many.select("key", "entries", F.ceil(F.col("entries") / LIST).cast("int").alias("blocks"))
    dealt = written(lists.join(many, "key"), "dealt")

    short = _streamed(dealt.where(F.col("entries") <= SHORT_LIST), ["key"], ["key", "gid", "root", "n", "place"], _short, "gid_a long, root_a long, gid_b long, root_b long").distinct()
    # members of one group in different components are pairs as well
    split = units.join(rooted.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid"), "gid", "left_semi")
    own = split.select("gid", F.col("root").alias("root_a")).join(split.select("gid", F.col("root").alias("root_b")), "gid").where("root_a < root_b")
    short = short.union(own.select(F.col("gid").alias("gid_a"), "root_a", F.col("gid").alias("gid_b"), "root_b"))
    a, b = (rooted.select(F.col("gid").alias(f"gid_{c}"), F.col("root").alias(f"root_{c}"), F.col("node").alias(c)) for c in "ab")
    short = short.join(a, ["gid_a", "root_a"]).join(b, ["gid_b", "root_b"]).select("a", "b")

    long = dealt.where(F.col("entries") > SHORT_LIST).join(rooted, ["gid", "root"])
    long = long.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = long.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    long = _streamed(long, ["key", "lo", "hi"], ["key", "lo", "hi", "block", "root", "node", "n", "place", "parity"], _long, "a long, b long", ("parity",))
    both = short.union(long).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return dealt, both.distinct()


def documents_with_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id): one row a row of ``docs`` (doc_id, text)."""
    return _with_firsts(docs).drop("stays")


def _with_firsts(docs: DataFrame) -> DataFrame:
    """The columns of documents_with_components(), and stays: whether (doc_id, text_key) is its component's least, a null id coming last."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    first = written(_sketch_and_nodes(docs), "nodes")
    prefixes = written(_prefixes(docs, _ranks(first.where("part is not null"))), "prefixes")
    clashes = _clashes(prefixes)
    apart = _told_apart(prefixes, clashes)
    members = written(apart.groupBy("node").agg(*[F.first(c).alias(c) for c in ("gid", "n", "parity")]), "members")
    lists = written(_lists(apart), "lists")
    drop_written(prefixes)

    # each group with the first few of its lists, and each member of a group with the group's first
    first_of = members.groupBy("gid").agg(F.min("node").alias("head"))
    heads = lists.select("gid", F.explode("others").alias("first")).distinct()
    across = heads.join(first_of.select("gid", F.col("head").alias("a")), "gid").join(first_of.select(F.col("gid").alias("first"), F.col("head").alias("b")), "first").select("a", "b")
    inside = members.select("gid", "node").join(first_of, "gid").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = across.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    likely = _likely(pairs, members)
    links = _verified(docs, likely, clashes)
    drop_written(likely)
    roots = components(links)

    # what is left: pairs of nodes in different components
    rooted = members.join(roots, "node", "left").select("gid", "node", F.coalesce("root", "node").alias("root"), "parity")
    dealt, between = _between(lists.select("key", "gid", "n", "place"), rooted)
    rest = _likely(between, members)
    drop_written(lists, dealt)
    if not rest.isEmpty():
        more = _verified(docs, rest, clashes)
        drop_written(roots)
        roots = components(links.union(more))
        drop_written(more)
    drop_written(rest, links, members)

    rows = _told_apart(first.where("part is null"), clashes).select("doc_id", "text_key", "n", "node")
    own = ["doc_id", "text_key"]
    placed = written(spread_join(rows, roots, "node", own).withColumn("root", F.coalesce("root", "node")), "placed")
    drop_written(first, roots)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), *own)
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(key).alias("least"))
    done = spread_join(placed, written(least, "least"), "root", own)
    stays = F.col("root").isNull() | F.col("least").eqNullSafe(key)
    return done.select(*own, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), stays.alias("stays"))


def _clashes(prefixes: DataFrame) -> list[int]:
    """Nodes that stand for two sets or more: some N**2 / 2**65 of N texts, three at 10**10."""
    found = prefixes.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
    return [r["node"] for r in found.select("node").collect()]


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least id and text key, and of equal rows any one."""
    found = _with_firsts(docs)
    verdict = written(found.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.first("stays").alias("stays")), "verdict")
    # names that no column of docs has
    key = fresh(docs.columns, "text_key")
    same = {c: fresh([*docs.columns, key], f"of_{c}") for c in ("doc_id", "text_key")}

    def those(which: str) -> DataFrame:
        return verdict.where(which).select(*[F.col(c).alias(n) for c, n in same.items()])

    keyed = docs.withColumn(key, F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col(same["doc_id"])) & F.col(key).eqNullSafe(F.col(same["text_key"]))
    stay = keyed.join(those("not stays"), on, "left_anti")
    again = those("stays and rows > 1")
    if again.isEmpty():
        return stay.drop(key)
    several = stay.join(again, on, "left_semi").dropDuplicates(["doc_id", key])
    return stay.join(again, on, "left_anti").unionByName(several).drop(key)

"""Token ids in binary files: fixed-width bit packing.

Every id takes the fewest bits that the vocabulary needs. A file holds whole documents in order of doc_id:

    the blocks of ids, each packed from a byte of its own, lowest bit first
    for each document: doc_id (i64 each), ids (u64 each), has an id (u8 each)
    for each block: its place in the file (u64)
    tail: magic "CWT2", bits (u32), ids in a block (u32), documents (u64), ids (u64)

so that a file is written as a stream, any id is found by its block's place, and a block is unpacked by a few numpy
operations.

Defined cases: a null or empty text gives the end id alone; a null doc_id comes first and stays null; repeated
rows stand side by side; an empty table gives no file and no row; texts of any length are encoded whole and may
span many blocks of a file.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm.chunks import Pieces, small_batches
from clauseworks.llm.common import new_path, running_total, written

MAGIC = b"CWT2"
TAIL = struct.Struct("<4sIIQQ")
END_ID = 2
#: Ids in a block, which a writer holds in memory; ids after which a file is closed.
BLOCK = 1 << 16
FILE_IDS = 1 << 26
MAX_KEPT = 600_000
#: Pieces encoded in one string, and the letter that stands for the space in a byte-level vocabulary.
TOGETHER = 2_000
SPACE = "\u0120"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, count: int, bits: int, first: int = 0) -> np.ndarray:
    """``count`` ids from the id ``first`` of a block on: each from the eight bytes in which it begins."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype(np.uint32)
    at = (np.arange(first, first + count, dtype=np.int64)) * bits
    flat = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(flat, 8)[at >> 3]
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenWriter:
    """Writes documents to an open stream; of the ids it holds one block, of the documents their ids and sizes."""

    def __init__(self, f, bits: int, block: int = BLOCK):
        self._f, self._bits, self._block = f, bits, block
        self._held, self._n_held, self._at = [], 0, 0
        self._doc_ids, self._sizes, self._given, self._places = array("q"), array("Q"), array("B"), array("Q")
        self.n_ids = 0

    @property
    def n_docs(self) -> int:
        return len(self._sizes)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document, of ids that are little-endian unsigned 32-bit integers."""
        self._doc_ids.append(doc_id or 0)
        self._given.append(doc_id is not None)
        self._sizes.append(len(ids) // 4)
        self._held.append(np.frombuffer(ids, dtype="<u4"))
        self._n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self._n_held >= self._block:
            flat = np.concatenate(self._held)
            whole = len(flat) - len(flat) % self._block
            for i in range(0, whole, self._block):
                self._put(flat[i : i + self._block])
            self._held, self._n_held = [flat[whole:].copy()], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self._bits:
            raise ValueError(f"an id needs more than {self._bits} bits")
        raw = pack(ids, self._bits)
        self._places.append(self._at)
        self._f.write(raw)
        self._at += len(raw)

    def close(self) -> None:
        if self._n_held:
            self._put(np.concatenate(self._held))
        for values, kind in ((self._doc_ids, "<i8"), (self._sizes, "<u8"), (self._given, "u1"), (self._places, "<u8")):
            self._f.write(np.array(values, dtype=kind).tobytes())
        self._f.write(TAIL.pack(MAGIC, self._bits, self._block, self.n_docs, self.n_ids))


def to_file(doc_ids: list[int | None], ids: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """The bytes of a file of documents."""
    out = io.BytesIO()
    w = TokenWriter(out, bits, block)
    for d, x in zip(doc_ids, ids, strict=True):
        w.add(d, x)
    w.close()
    return out.getvalue()


class TokenFile:
    """Random access to an open file."""

    def __init__(self, f):
        self._f = f
        end = f.seek(0, os.SEEK_END) - TAIL.size
        f.seek(end)
        magic, self.bits, self.block, self.n_docs, self.n_ids = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        n, blocks = self.n_docs, -(-self.n_ids // self.block)
        f.seek(end - 17 * n - 8 * blocks)
        table = f.read(17 * n + 8 * blocks)
        self._doc_ids = np.frombuffer(table, "<i8", n)
        self.sizes = np.frombuffer(table, "<u8", n, 8 * n).astype(np.int64)
        self._given = np.frombuffer(table, "u1", n, 16 * n)
        self.places = np.frombuffer(table, "<u8", blocks, 17 * n).astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self._at, self._raw = -1, b""

    def doc_id(self, i: int) -> int | None:
        return int(self._doc_ids[i]) if self._given[i] else None

    def _load(self, k: int) -> bytes:
        if k != self._at:
            self._f.seek(int(self.places[k]))
            count = min(self.block, self.n_ids - k * self.block)
            self._at, self._raw = k, self._f.read(-(-count * self.bits // 8))
        return self._raw

    def ids(self, first: int, count: int) -> np.ndarray:
        parts = []
        while count:
            k, at = divmod(first, self.block)
            n = min(count, self.block - at)
            parts.append(unpack(self._load(k), n, self.bits, at))
            first, count = first + n, count - n
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.sizes[i]))


@cache
def coder(path: str) -> Pieces:
    """Pieces encoded by the tokenizers library."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # Only a piece's first token begins with a space: so pieces may be encoded in one string and told apart again.
    begins = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        begins[i] = token[0] == SPACE

    def encode_pieces(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(pieces), TOGETHER):
            some = pieces[a : a + TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(begins[ids])
            if len(at) != len(some):
                out += encode(some)
                continue
            raw, edges = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            out += [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return out

    return Pieces(encode, encode_pieces, MAX_KEPT)


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), urlsplit(uri).path) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, draft: str, name: str) -> None:
    """Gives a draft its name. Not every file system renames over a file: one that an earlier attempt at the same task
    left there is whole, has the same bytes, and stays."""
    if fs.get_file_info(name).type == pafs.FileType.File:
        fs.delete_file(draft)
    else:
        fs.move(draft, name)


def _new_folder(spark: SparkSession) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "tokens"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


def write(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and returns the table of files, in order: file, start, n_docs, n_ids."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or _new_folder(spark)
    bits = bits_for(max(vocabulary(path), end_id + 1))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        part, made = TaskContext.get().partitionId(), []
        now: tuple[TokenWriter, pa.NativeFile, str] | None = None

        def close() -> None:
            w, f, draft = now
            w.close()
            f.close()
            name = f"{part:08d}-{len(made):06d}.tok"
            publish(fs, draft, f"{root}/{name}")
            made.append((f"{folder}/{name}", part, len(made), w.n_docs, w.n_ids))

        for batch in batches:
            new = coder(path).encode_all([t or "" for t in batch.column("text").to_pylist()])
            for d, x in zip(batch.column("doc_id").to_pylist(), new, strict=True):
                if now is None:
                    draft = f"{root}/.{uuid.uuid4().hex}"
                    f = fs.open_output_stream(draft)
                    now = TokenWriter(f, bits), f, draft
                now[0].add(d, x + end)
                if now[0].n_ids >= FILE_IDS:
                    close()
                    now = None
        if now is not None:
            close()
        columns = list(zip(*made, strict=True)) if made else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "part", "seq", "n_docs", "n_ids"])

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    files = written(ordered.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long"), "token-files")
    starts = running_total(files, [], "part", ["seq"], "n_ids", "upto")
    return starts.select("file", (F.col("upto") - F.col("n_ids")).alias("start"), "n_docs", "n_ids")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids is binary, little-endian unsigned 32-bit. As many tasks as files read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = _filesystem(name)
                with fs.open_input_file(at) as f:
                    t = TokenFile(f)
                    for i in range(0, t.n_docs, 200):
                        k = range(i, min(i + 200, t.n_docs))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([t.doc_id(j) for j in k], pa.int64()),
                                pa.array(start + t.firsts[k.start : k.stop], pa.int64()),
                                pa.array(t.sizes[k.start : k.stop], pa.int64()),
                                pa.array([t.document(j).astype("<u4").tobytes() for j in k], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    # a number that is given is kept, however small the table of files
    return files.select("file", "start").repartition(max(1, files.count()), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``docs``, as read back from the files that they are written to."""
    return read(write(docs, path, end_id)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

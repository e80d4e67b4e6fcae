"""Token ids in files: a wavelet matrix per shard.

A shard holds the ids of documents that follow one another by doc_id. Its file is a wavelet matrix: one bit-plane per
bit of an id, from the highest; below each plane the sequence is dealt into zeros and ones. With the counts of ones before
each block of a plane, which the file holds, it answers without the sequence itself: the id at a place (access), how often
an id occurs before a place or between two (rank, count) and where its k-th occurrence is (select). Planes are compressed in
blocks; StoredMatrix reads just those that a question needs, from one file.

Files go to the folder that driver and executors share, each under a name of its own attempt; the manifest of committed
tasks says which files count. Shards are ranges of doc_id that hold about equal bytes, so a hot source, a group of copies or a run of long texts is no hot shard.

Defined results: a null text has the end id only, as an empty one. doc_ids are taken to be unique; rows that repeat one
follow each other, and rows without one come before all others (the header says how many a file begins with). A very long text makes its shard as long (some 40 bytes an id in the task that writes it). Columns
beside those named are ignored. An empty table has no shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.common import Work, byte_shards, parts, size_of
from hushframe.llm.tokens import default_path, encoder

#: Bytes of text of a shard, about; texts encoded at once; bits of a compressed block; compression level.
SHARD_BYTES, BATCH, BLOCK_BITS, LEVEL = 16 << 20, 1024, 1 << 18, 1
BLOCK_WORDS = BLOCK_BITS // 64
#: Blocks that an open file keeps; shards of a group in the manifest's running sums.
KEPT, GROUP = 64, 1000
#: Ids after which a task begins another file; files of a task at most, in their numbers.
FILE_IDS, FILES = 16 << 20, 1 << 20
MAGIC = b"HWM2"
END = 0


class WaveletMatrix:
    """A sequence of ids below 2**bits in bit-planes with rank and select.

    A plane is words of 64 bits; ones[level][k] counts those before its k-th block of BLOCK_BITS. Here all planes are in
    memory; StoredMatrix reads blocks of a file as they are asked for.
    """

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.ones = n, bits, planes, zeros, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << b)) != 0
            planes.append(_words(one))
            low = x[~one]
            zeros.append(len(low))
            x = np.concatenate([low, x[one]])
        return cls(len(ids), bits, planes, zeros, [_directory(p) for p in planes])

    def block(self, level: int, k: int) -> np.ndarray:
        """The words of a block."""
        return self.planes[level][k * BLOCK_WORDS : (k + 1) * BLOCK_WORDS]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane: those before its block, and those in the block."""
        k, r = divmod(i, BLOCK_BITS)
        w, r = divmod(r, 64)
        words = self.block(level, k)
        return int(self.ones[level][k]) + int(np.bitwise_count(words[:w]).sum()) + (int(words[w] & np.uint64((1 << r) - 1)).bit_count() if r else 0)

    def _bit(self, level: int, i: int) -> int:
        k, r = divmod(i, BLOCK_BITS)
        return int(self.block(level, k)[r // 64]) >> r % 64 & 1

    def access(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        """Where, below the last plane, the symbol's occurrences within [start, end) stand."""
        if symbol >> self.bits or symbol < 0:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if symbol >> self.bits - 1 - level & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol before place i."""
        a, b = self._range(symbol, 0, i)
        return b - a

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a symbol within [start, end)."""
        a, b = self._range(symbol, start, self.n if end is None else end)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind in a plane: its block by the directory, then its word, then its bit."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK_BITS - self.ones[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        words = self.block(level, block)
        k -= int(before[block])
        each = np.cumsum(np.bitwise_count(words if bit else ~words), dtype=np.int64)
        w = int(np.searchsorted(each, k, "right"))
        k -= int(each[w - 1]) if w else 0
        word = int(words[w]) if bit else ~int(words[w]) & (1 << 64) - 1
        for _ in range(k):
            word &= word - 1
        return block * BLOCK_BITS + w * 64 + (word & -word).bit_length() - 1

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a symbol."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = symbol >> self.bits - 1 - level & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def access_many(self, places: np.ndarray) -> np.ndarray:
        """The ids at places, a plane at a time."""
        i, value = places.astype(np.int64), np.zeros(len(places), np.int64)
        for level, words in enumerate(self.planes):
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            w, r = i // 64, (i % 64).astype(np.uint64)
            bit = (words[w] >> r & np.uint64(1)).astype(bool)
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << r) - np.uint64(1)))
            value = value << 1 | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return value

    def rank_many(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol before each of some places, a plane at a time."""
        i, start = places.astype(np.int64), 0
        for level, words in enumerate(self.planes):
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            w, r = i // 64, (i % 64).astype(np.uint64)
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << r) - np.uint64(1)))
            first = self._rank1(level, start)
            i, start = (self.zeros[level] + ones, self.zeros[level] + first) if symbol >> self.bits - 1 - level & 1 else (i - ones, start - first)
        return i - start

    def all(self) -> np.ndarray:
        """The whole sequence: from the lowest plane up, the two halves are put back in their places."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[~one] = x[: self.zeros[level]]
            y[one] = x[self.zeros[level] :] | x.dtype.type(1 << self.bits - 1 - level)
            x = y
        return x.astype(np.uint32)


class StoredMatrix(WaveletMatrix):
    """A matrix in an open file: access, rank, count and select read (and keep, up to KEPT) just the blocks they need."""

    def __init__(self, f: BinaryIO):
        head, self.data = _head(f)
        super().__init__(head["n"], head["bits"], [], head["zeros"], [np.array(o) for o in head["ones"]])
        sizes = [s for p in head["blocks"] for s in p]
        self.f, self.kept, self.per_plane = f, {}, len(head["blocks"][0])
        self.offsets = np.r_[0, np.cumsum(sizes)].tolist()
        self.doc_ids, self.lengths = _documents(f, head)
        self.data += head["table"]

    def block(self, level: int, k: int) -> np.ndarray:
        at = level * self.per_plane + k
        if at not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.f.seek(self.data + self.offsets[at])
            self.kept[at] = np.frombuffer(zlib.decompress(self.f.read(self.offsets[at + 1] - self.offsets[at])), "<u8")
        return self.kept[at]


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(-(-len(bits) // 64) + 1, np.uint64)  # a word more, so that the end can be ranked
    out.view(np.uint8)[: len(packed)] = packed
    return out


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane."""
    sums = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK_WORDS), dtype=np.int64)
    return np.r_[0, np.cumsum(sums)[:-1]]


def save(out: BinaryIO, matrix: WaveletMatrix, doc_ids: np.ndarray, lengths: np.ndarray, nameless: int = 0) -> None:
    """One file: header with the counts before each block, document table (the first nameless documents have no id), planes in compressed blocks."""
    table = zlib.compress(np.stack([doc_ids.astype("<i8"), lengths.astype("<i8")]).tobytes(), LEVEL)
    blocks = [[zlib.compress(p[i : i + BLOCK_WORDS].astype("<u8").tobytes(), LEVEL) for i in range(0, len(p), BLOCK_WORDS)] for p in matrix.planes]
    head = json.dumps({"n": matrix.n, "bits": matrix.bits, "zeros": matrix.zeros, "ones": [o.tolist() for o in matrix.ones], "docs": len(doc_ids), "nameless": nameless, "table": len(table), "blocks": [[len(b) for b in p] for p in blocks]}).encode()
    out.write(MAGIC + len(head).to_bytes(8, "little") + head + table)
    for p in blocks:
        for b in p:
            out.write(b)


def _head(f: BinaryIO) -> tuple[dict, int]:
    """The header, and where it ends."""
    if f.read(4) != MAGIC:
        raise ValueError("no file of token ids")
    size = int.from_bytes(f.read(8), "little")
    return json.loads(f.read(size)), 12 + size


def _documents(f: BinaryIO, head: dict) -> np.ndarray:
    return np.frombuffer(zlib.decompress(f.read(head["table"])), "<i8").reshape(2, head["docs"])


def load(f: BinaryIO) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, int]:
    """A whole file: the matrix, doc_ids, lengths, and how many documents it begins with have no id."""
    head, _ = _head(f)
    doc_ids, lengths = _documents(f, head)
    planes = [np.frombuffer(b"".join(zlib.decompress(f.read(size)) for size in p), "<u8") for p in head["blocks"]]
    return WaveletMatrix(head["n"], head["bits"], planes, head["zeros"], [np.array(o) for o in head["ones"]]), doc_ids, lengths, head["nameless"]


def write_shards(work: Work, docs: DataFrame, folder: str, tokenizer: str, n_shards: int, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes files in ascending order of the key; returns the manifest (part: the file's number in that order, path, first, last, docs, n).

    Tasks hold ranges of keys of about equal bytes. One that is given over FILE_IDS ids all the same, as by many rows of one key,
    closes its file there and begins another.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = np.array([end], enc.dtype).tobytes()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, keys, ids, held = -1, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal part
            names = pa.concat_arrays(keys)
            whole = np.frombuffer(b"".join(ids), enc.dtype)
            lengths = np.array([len(x) // whole.itemsize for x in ids], np.int64)
            ids.clear()
            path = f"{base}/{uuid.uuid4().hex}.hwm"
            with fs.open_output_stream(path, compression=None) as out:
                save(out, WaveletMatrix.build(whole), names.fill_null(0).to_numpy(), lengths, names.null_count)
            row = {"part": part, "path": path, "first": names[0].as_py(), "last": names[-1].as_py(), "docs": len(names), "n": len(whole)}
            part += 1
            return pa.RecordBatch.from_pylist([row], manifest)

        for b in batches:
            if part < 0 and b.num_rows:
                part = b.column(2)[0].as_py() * FILES
            for i in range(0, b.num_rows, BATCH):
                rows = b.slice(i, BATCH)
                keys.append(rows.column(0))
                ids += [x + tail for x in enc.encode(rows.column(1))]
                held += sum(map(len, ids[len(ids) - rows.num_rows :]))
                if held >= FILE_IDS * len(tail):
                    yield close()
                    keys, held = [], 0
        if ids:
            yield close()

    manifest = pa.schema([("part", pa.int64()), ("path", pa.string()), *[(c, pa.int64()) for c in ("first", "last", "docs", "n")]])
    own = docs.select(F.col(key).cast("long").alias(key), text)
    place = F.coalesce(F.col(key), F.lit(-(1 << 63)))  # rows without a key come first
    dealt = byte_shards(work, own, place, F.coalesce(F.octet_length(text), F.lit(0)) + 1, n_shards).repartitionById(n_shards, "shard").sortWithinPartitions(key)
    return dealt.select(key, text, "shard").mapInArrow(write, "part long, path string, first long, last long, docs long, n long")


def read_shards(manifest: DataFrame, folder: str, key: str = "doc_id", end: int = END) -> DataFrame:
    """key, start, n_tokens, ids_crc32 and n_end_ids of each document, from the files of a manifest.

    The structure is asked for what it is made for: access says that each document ends with the end id, rank how often that id
    occurs in it (where it is also a piece of text, more than once), and count and select, which read single blocks of the
    file, how often it occurs in the shard and that its last occurrence is the shard's end.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with fs.open_input_stream(path, compression=None) as f:
                    matrix, doc_ids, lengths, nameless = load(f)
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(lengths)
                if matrix.n != lengths.sum() or (matrix.access_many(ends - 1) != end).any():
                    raise ValueError(f"{path}: documents do not end where they should")
                ranks = matrix.rank_many(end, np.r_[0, ends])
                with fs.open_input_file(path) as f:
                    stored = StoredMatrix(f)
                    if stored.count(end) != ranks[-1] or stored.select(end, int(ranks[-1]) - 1) != matrix.n - 1:
                        raise ValueError(f"{path}: the directory of ranks does not fit the planes")
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=np.arange(len(doc_ids)) < nameless), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.diff(ranks))], [key, "start", "n_tokens", "ids_crc32", "n_end_ids"])

    return begun(manifest).repartition(max(1, manifest.count()), "path").mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids_crc32 long, n_end_ids long")


def begun(manifest: DataFrame) -> DataFrame:
    """path and start (ids of all files before it) of a manifest: running sums within groups of GROUP shards, and over the sums of groups."""
    grouped = manifest.withColumn("g", F.floor(F.col("part") / (GROUP * FILES)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("g").agg(F.sum("n").alias("s"))
    before = sums.select("g", F.coalesce(F.sum("s").over(earlier(Window.orderBy("g"))), F.lit(0)).alias("before"))  # a row a group
    own = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("g").orderBy("part"))), F.lit(0))
    return grouped.withColumn("own", own).join(F.broadcast(before), "g").select("path", (F.col("before") + F.col("own")).alias("start"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    work = Work(spark, "tokens")
    folder = work.path("shards")
    _, size = size_of(docs)
    manifest = work.table(write_shards(work, docs, folder, default_path("byte_bpe_50k.json"), parts(size, SHARD_BYTES)), "manifest")
    return read_shards(manifest, folder)


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}

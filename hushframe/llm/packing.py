"""Packing of documents into training sequences by lexical retrieval.

Documents are encoded, given a locality key (the least hash of their ids' pairs; texts that share phrases tend to share it,
and long texts, whose least hashes are small, lie at the lower end) and dealt into shards of equal bytes by ranges of that
key; copies lie together, but any number of them is cut. A shard has one BM25 inverted index over the token ids
of all its documents. A window begins with a seed (what is left of the last document, or else the next unused one); the
index returns the unused neighbours of the seed among all documents of the shard, best first, and they fill the window
greedily. The document that crosses the window's end is cut there and its rest is the next seed, so windows have no
padding. The few ids that are left at a shard's end go to sequences whose lengths are powers of two, without padding.

Used documents are taken out of the index's lists from time to time; the statistics stay those of the whole shard, so
scores do not depend on it.

Defined results: a null or empty text is its end id alone. Of equal scores the document that comes first wins. Repeated
rows (also of one doc_id) are documents each, and so are those without a doc_id, which stays null. Terms in over half of a shard have no weight, as BM25's idf, floored at 0,
gives them none. Columns beside those named are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from hushframe.llm.common import Work, as_long, byte_shards, mix, parts, size_of, spread, trim
from hushframe.llm.tokens import default_path, encoder, forget

WINDOW, END = 2048, 1
#: BM25's parameters; ids of a shard, about; texts encoded at once.
K1, B, SHARD_IDS, BATCH = 1.2, 0.75, 8 << 20, 1024
#: Cells an id up to which documents are counted in tables of all terms, not by sorting.
CELLS = 16
#: Ids that are counted at once; neighbours sorted at first (more follow if a window asks for them); pieces put out at once.
BLOCK, FIRST, ROWS = 1 << 20, 32, 8192
#: Pieces in an encoder's table where executors are full already.
LEAN_TABLE = 300_000
#: Ids whose pairs are hashed at once: few enough to stay in a processor's cache.
PAIRS = 1 << 16
#: Used documents leave the lists when fewer than this share of those in them is unused.
LIVE = 0.8
#: A term in at least this share of a shard's documents has a row of weights of all documents in place of a list.
DENSE = 0.06
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Documents:
    """Documents as one array of ids and the places where they begin (and the last ends)."""

    def __init__(self, flat: np.ndarray, begins: np.ndarray):
        self.flat, self.begins = flat, begins

    @classmethod
    def of(cls, ids: list[np.ndarray]) -> Documents:
        return cls(np.concatenate(ids), np.r_[0, np.cumsum([len(x) for x in ids])])

    def __len__(self) -> int:
        return len(self.begins) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.begins[i] : self.begins[i + 1]]

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """slot (a number for each term that occurs), document, occurrences: by document, then by slot; and the number of slots."""
        seen = np.bincount(self.flat, minlength=1) > 0
        number, v = (np.cumsum(seen) - 1).astype(np.int32), int(np.count_nonzero(seen))
        found, at, table = [], 0, v * len(self) <= CELLS * len(self.flat)
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(self.begins, self.begins[at] + BLOCK, "right")) - 1)
            to = min(to, at + max(1, BLOCK // v)) if table else to
            code = number[self.flat[self.begins[at] : self.begins[to]]].astype(np.int64)
            code += np.repeat(np.arange(to - at, dtype=np.int64) * v, np.diff(self.begins[at : to + 1]))
            if table:
                tf = np.bincount(code)
                code = np.flatnonzero(tf)
                tf = tf[code]
            else:
                code, tf = np.unique(code, return_counts=True)
            doc = code // v
            found.append((code - doc * v, doc + at, tf))
            at = to
        return *(np.concatenate(x) for x in zip(*found)), v


class Index:
    """A BM25 inverted index of documents: lists of documents and weights; of frequent terms, rows of weights."""

    def __init__(self, ids: list[np.ndarray] | Documents):
        documents = ids if isinstance(ids, Documents) else Documents.of(ids)
        n, sizes = len(documents), np.diff(documents.begins)
        slot, docs, tf, v = documents.counts()
        df = np.bincount(slot, minlength=v)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1))
        keep = ((idf > 0) & (df > 1))[slot]  # a list of the seed alone has no neighbour
        self.slots, docs, tf = slot[keep], docs[keep], tf[keep]
        self.ends = np.searchsorted(docs, np.arange(n + 1))
        weights = idf[self.slots] * tf * (K1 + 1) / (tf + norm[docs])
        wide = (df >= DENSE * n) & (idf > 0) & (df > 1)
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)  # of a term: its row, or -1
        at, listed = self.row[self.slots], ~wide[self.slots]
        self.rows = np.zeros((int(wide.sum()), n), np.float32)
        self.rows[at[~listed], docs[~listed]] = weights[~listed]
        order = np.argsort(self.slots[listed], kind="stable")
        self.docs, self.weights = docs[listed][order], weights[listed][order]  # of the types that bincount works on
        self.starts = np.r_[0, np.cumsum(np.bincount(self.slots[listed], minlength=len(df)))]
        self.live = np.arange(n)  # the documents that the lists' numbers stand for

    def forget(self, unused: np.ndarray) -> None:
        """Takes the documents out of the lists and rows that are used, if they are many."""
        left = unused[self.live]
        if np.count_nonzero(left) >= LIVE * len(left):
            return
        keep = left[self.docs]
        self.starts = np.r_[0, np.cumsum(keep)][self.starts]
        self.docs, self.weights = (np.cumsum(left) - 1)[self.docs[keep]], self.weights[keep]
        self.rows = np.ascontiguousarray(self.rows[:, left])
        self.live = self.live[left]

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """The unused documents that share a weighted term with a seed document (at most so many), by falling score."""
        slots = self.slots[self.ends[seed] : self.ends[seed + 1]]
        row = self.row[slots]
        scores = np.add.reduce(self.rows[row[row >= 0]], axis=0, dtype=np.float32) if len(self.rows) else np.zeros(len(self.live), np.float32)
        listed = slots[row < 0]
        lists = [slice(a, z) for a, z in zip(self.starts[listed].tolist(), self.starts[listed + 1].tolist()) if a < z]
        if lists:
            docs, weights = (np.concatenate([x[k] for k in lists]) for x in (self.docs, self.weights))
            scores = scores + np.bincount(docs, weights, len(self.live))
        scores[~unused[self.live]] = 0.0
        least = np.partition(scores, len(scores) - most)[len(scores) - most] if most and most < len(scores) else 0.0
        at = np.flatnonzero((scores >= least) & (scores > 0))
        return self.live[at[np.argsort(-scores[at], kind="stable")[:most]]]


class Packer:
    """Deals a stream of documents into windows; rows gathers the pieces."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence, self.filled, self.rows = window, first_sequence, 0, []
        self.open: list[tuple[int, np.ndarray, int, int]] = []  # pieces of the open window: document, its ids, start, length

    def _piece(self, doc: int, ids: np.ndarray, start: int, length: int) -> None:
        part = ids[start : start + length]
        self.rows.append((doc, start, length, zlib.crc32(part.astype("<u4")), len(ids), self.sequence, self.filled))
        self.filled += length

    def add(self, doc: int, ids: np.ndarray) -> bool:
        """Appends a document, and says whether its rest begins a window."""
        start = 0
        while start < len(ids):
            room = self.window - sum(n for _, _, _, n in self.open) if self.open else self.window
            length = min(room, len(ids) - start)
            self.open.append((doc, ids, start, length))
            start += length
            if length == room:
                self._flush(self.window)
        return bool(self.open) and len(self.open) == 1 and self.open[0][0] == doc

    def room(self) -> int:
        return self.window - sum(n for _, _, _, n in self.open)

    def _flush(self, size: int) -> None:
        """Closes a sequence of the first size ids of the open window."""
        rest = []
        for doc, ids, start, length in self.open:
            now = min(length, size - self.filled)
            if now:
                self._piece(doc, ids, start, now)
            if now < length:
                rest.append((doc, ids, start + now, length - now))
        self.open, self.filled = rest, 0
        self.sequence += 1

    def finish(self) -> None:
        """What is left, in sequences of powers of two."""
        left = sum(n for _, _, _, n in self.open)
        while left:
            size = 1 << left.bit_length() - 1
            self._flush(size)
            left -= size


def pack_shard(packer: Packer, keys: np.ndarray, docs: Documents) -> Iterator[None]:
    """All documents of a shard, each window led by a seed and filled by its neighbours. Stops where rows can be taken."""
    index = Index(docs)
    unused = np.ones(len(docs), bool)
    seed, most, queue, first = None, 0, [], 0
    for _ in range(len(docs)):
        if not queue and seed is not None:  # the best neighbours are used up
            most *= 8
            queue = index.neighbours(seed, unused, most)[::-1].tolist()
            seed = seed if len(queue) == most else None
        if queue:
            nxt = queue.pop()
        else:
            while not unused[first]:
                first += 1
            nxt = first
        unused[nxt] = False
        leads = packer.add(int(keys[nxt]), docs[nxt])
        if leads:
            index.forget(unused)
            most = FIRST
            queue = index.neighbours(nxt, unused, most)[::-1].tolist()
            seed = nxt if len(queue) == most else None
        elif not packer.open:  # a window that no document leads
            seed, queue = None, []
        if len(packer.rows) >= ROWS:
            yield


def least_pairs(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least hash of each document's pairs of ids that follow each other; 0 for a document of one id. flat: the ids of all, sizes: how many each has (one at least)."""
    ends, out, at = np.cumsum(sizes), np.zeros(len(sizes), np.uint64), 0
    while at < len(sizes):
        start = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, start + PAIRS, "right")))
        x = flat[start : ends[to - 1]].astype(np.uint64)
        pairs = np.full(len(x), ~np.uint64(0))
        pairs[:-1] = mix(x[:-1] << np.uint64(32) | x[1:])
        pairs[ends[at:to] - 1 - start] = ~np.uint64(0)  # the last id begins no pair
        own = np.minimum.reduceat(pairs, ends[at:to] - sizes[at:to] - start)
        out[at:to] = np.where(sizes[at:to] > 1, own, np.uint64(0))
        at = to
    return out


def encode(docs: DataFrame, tokenizer: str, end: int = END, key: str = "doc_id", text: str = "text", lean: bool = False) -> DataFrame:
    """key, near (the locality key), ids (with the end id, packed in the encoder's dtype). lean: in less memory and more time, with a smaller table of pieces and freed memory given back after each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        enc.most = LEAN_TABLE if lean else None
        tail = np.array([end], enc.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                ids = [x + tail for x in enc.encode(part.column(1))]
                near = least_pairs(np.frombuffer(b"".join(ids), enc.dtype), np.array([len(x) // len(tail) for x in ids]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(as_long(near)), pa.array(ids, pa.binary())], [key, "near", "ids"])
                del ids, near
                if lean:
                    trim()

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(work, f"`{key}` long, near long, ids binary")


def in_shards(work: Work, encoded: DataFrame, n_shards: int, key: str = "doc_id") -> DataFrame:
    """encoded with shard, a number below n_shards: ranges of the locality key of about equal bytes.

    The place's low bits are those of a hash of the row, so copies and repeated rows, which share a key, lie together but are
    cut like all others.
    """
    row = F.xxhash64(key, F.monotonically_increasing_id())
    placed = encoded.withColumn("place", F.shiftleft(F.shiftright("near", 20), 20) + F.pmod(row, F.lit(1 << 20)))
    return byte_shards(work, placed, F.col("place"), F.octet_length("ids"), n_shards).select(key, "near", "ids", "shard")


def pack(work: Work, encoded: DataFrame, n_shards: int, window: int = WINDOW, key: str = "doc_id", dtype: str = "<u4", lean: bool = False) -> DataFrame:
    """The pieces (see PIECES) of encoded documents; dtype: of their packed ids. lean: workers drop their tables of pieces first, which encoding would fill anew."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lean:  # ids are all that is needed from here on
            forget()
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        keys, flat, sizes = [], [], []

        def out() -> pa.RecordBatch:
            place, *columns = [pa.array(c, pa.int64()) for c in zip(*packer.rows)]
            packer.rows = []
            return pa.RecordBatch.from_arrays([ids_of.take(place), *columns], _NAMES)

        for b in batches:
            if b.num_rows:
                ids = b.column(1).cast(pa.large_binary())
                ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
                keys.append(b.column(0))  # as Arrow holds them, with those that are null
                flat.append(np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype))
                sizes.append(np.diff(ends) // np.dtype(dtype).itemsize)
        if not keys:
            return
        docs = Documents(np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(sizes))])
        del flat
        ids_of = pa.concat_arrays(keys)
        for _ in pack_shard(packer, np.arange(len(docs)), docs):
            yield out()
        packer.finish()
        if packer.rows:
            yield out()

    dealt = in_shards(work, encoded, n_shards, key).repartitionById(n_shards, "shard").sortWithinPartitions("near", key)
    return dealt.select(key, "ids").mapInArrow(deal, PIECES)


def packed(spark: SparkSession, docs: DataFrame, tokenizer: str, lean: bool = False) -> DataFrame:
    work = Work(spark, "packing")
    encoded = work.table(encode(spread(docs), tokenizer, lean=lean), "encoded")
    _, size = size_of(encoded, "ids")
    dtype = encoder(tokenizer).dtype
    return work.table(pack(work, encoded, parts(size, SHARD_IDS * np.dtype(dtype).itemsize), dtype=dtype, lean=lean), "pieces")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_path("word_bpe_49k.json"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents in their sequences. Executors hold what the stages before have left, so tables are small and dropped early."""
    return packed(spark, docs.select("doc_id", "text"), default_path("word_bpe_49k.json"), lean=True)


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}

"""Alignment of two tokenizers over a corpus, by dense count matrices in stripes of ids.

Both tokenizers encode the same bytes. Byte offsets at which tokens of both end cut a text into groups, and every token of
side A is linked with every token of side B in its group. How many documents hold an id pair linked is counted in dense
matrices: side A's ids are dealt to STRIPES stripes by remainder (so frequent ids, which are neighbours, are in different
ones), and a stripe is a block of its A ids by all B ids, into which np.add.at adds. A row's maximum is the best count of
its A id. The links of each document lie under the same stripes, so they are scored beside their stripe's counts.

1. Blocks of about tokens.CHARS bytes of text are encoded and aligned, and written: a row a document, and a row a stripe
   with the block's pairs, the documents that hold each, and how often. A text is cut into units where both tokenizers
   always cut (before a space or a line end after other characters; between a letter and a mark), and each different unit
   is aligned once and kept in a bounded table.
2. Stripes are counted, SLICE blocks in one task, so no stripe is one task; what the tasks found is summed by stripe.
3. Each stripe's links are scored beside its counts, again SLICE blocks in one task; a block's documents sum their stripes.

Defined results: a null or empty text, and one whose tokens' bytes differ from space+text on either side (U+2581, which
reads as a space), has no tokens: zeros, and '' for the digest. Strings of special tokens are plain text. Repeated rows are
documents of their own and count each; a null id is carried. An empty table has no rows. A very long text is a block of its
own, and one unit of it is aligned at once; a group of many tokens has the product of their numbers as links, which are
kept as distinct pairs with counts. Columns beside those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import tokens
from hushframe.llm.common import Work, pack_counts, pack_keys, spread, unpack_counts, unpack_keys

#: Stripes of A's ids, and blocks that one task counts or scores at once in a stripe.
STRIPES, SLICE = 128, 128
#: Units in a worker's table, after which it is emptied; only memory depends on it. Longer units aren't kept. Links of a group that are listed one by one.
TABLE, LONGEST, SMALL = 400_000, 32, 4096
#: Where texts with odd white space are cut.
_UNITS = re.compile(r"(?<=\S)(?=[ \n])")


class Aligner:
    """Units of text to their groups and links; keeps what it has aligned."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = tokens.Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        read = {letter: byte for byte, letter in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = {i: bytes(map(read.__getitem__, t)) for t, i in vocabulary.items() if all(c in read for c in t)}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.long_a, self.long_b = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]
        self.names = [b"%d" % i for i in range(max(self.n_a, self.n_b))]
        self.mark = self.b.encode("\n")  # before a unit it takes the space that is put before a text, and joins nothing
        self.table: dict[str, tuple] = {}

    def _align(self, unit: str, a: list[int], b: list[int]) -> tuple:
        """(bad, n_a, n_b, n_groups, n_links, groups as text, pairs as a * n_b + b, how often each: nothing if once each), the last two as bytes of 64-bit numbers."""
        raw, long_a, long_b, names, n_b = unit.encode(), self.long_a, self.long_b, self.names, self.n_b
        if b"".join([self.bytes_a[x] for x in a]) != raw or b"".join([self.bytes_b[x] for x in b]) != raw:
            return 1, 0, 0, 0, 0, b"", b"", b""
        i = j = end_a = end_b = links = 0
        said, pairs, large = [], [], None
        while i < len(a):
            i0, j0 = i, j
            end_a, end_b, i, j = end_a + long_a[a[i]], end_b + long_b[b[j]], i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a, i = end_a + long_a[a[i]], i + 1
                else:
                    end_b, j = end_b + long_b[b[j]], j + 1
            own_a, own_b = a[i0:i], b[j0:j]
            said.append(b",".join([names[x] for x in own_a]) + b"|" + b",".join([names[y] for y in own_b]) + b";")
            n = len(own_a) * len(own_b)
            links += n
            if n <= SMALL:
                pairs += [x * n_b + y for x in own_a for y in own_b]
            else:
                large, more = large or Counter(), Counter(own_b)
                for x, k in Counter(own_a).items():
                    for y, m in more.items():
                        large[x * n_b + y] += k * m
        often = b""
        if large or len(set(pairs)) < len(pairs):
            large = large or Counter()
            large.update(pairs)
            pairs, often = list(large), array("q", large.values()).tobytes()
        return 0, len(a), len(b), len(said), links, b"".join(said), array("q", pairs).tobytes(), often

    def units(self, kinds: list[str]) -> list[tuple]:
        """What each of some different units is."""
        missing = [u for u in kinds if u not in self.table]
        if len(self.table) + len(missing) > TABLE:
            self.table.clear()
            missing = kinds
        self.a._add(set(missing))
        skip, mark, ids, kind = len(self.mark), self.mark, self.a.table, self.a.kind
        for u, b in zip(missing, self.b.encode(["\n" + u for u in missing], num_threads=1)):
            if b[:skip] != mark:
                raise ValueError("the tokenizer of side B joins a line end with what follows it")
            self.table[u] = self._align(u, memoryview(ids[u]).cast(kind).tolist(), b[skip:])
        self.a.table.clear()
        found = [self.table[u] for u in kinds]
        for u in missing:
            if len(u) > LONGEST:
                del self.table[u]
        return found

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's units begin (and the last one's end) among all units, and the units."""
        parts = pc.replace_substring_regex(texts, tokens._MARK, "\\1\0\\2")
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(parts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        odd = pc.match_substring_regex(texts, tokens._ODD)
        if pc.any(odd).as_py():
            found = pa.array([_UNITS.split(t) if o else [] for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))
            lists = pc.if_else(odd, found, lists)
        return lists.offsets.to_numpy(), lists.flatten()

    def block(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: numbers (n_a, n_b, n_groups, n_links) and digest of each; and all links: document, pair and how often, in no order."""
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        begins, units = self.cut(pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), ""))
        coded = units.dictionary_encode()
        at, kinds = coded.indices.to_numpy(), self.units(coded.dictionary.to_pylist())
        begins = begins - begins[0]
        numbers = np.array([k[:5] for k in kinds], np.int64).reshape(-1, 5)
        sums = np.r_[np.zeros((1, 5), np.int64), np.cumsum(numbers[at], axis=0)]
        per_doc = sums[begins[1:]] - sums[begins[:-1]]
        good = some & (per_doc[:, 0] == 0)
        said = pa.array([k[5] for k in kinds], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1][begins].tolist()
        data = memoryview(said.buffers()[2] or b"")
        digests = [hashlib.sha256(data[a : z - 1]).hexdigest() if g else "" for a, z, g in zip(ends, ends[1:], good)]
        doc = np.repeat(np.arange(len(texts)), np.diff(begins))
        use = good[doc]
        held, times = np.unique(doc[use] * len(kinds) + at[use], return_counts=True)
        doc, unit = held // max(len(kinds), 1), held % max(len(kinds), 1)
        size = np.array([len(k[6]) for k in kinds], np.int64) // 8
        first = np.r_[0, np.cumsum(size)]
        pairs, often = np.frombuffer(b"".join([k[6] for k in kinds]), np.int64), np.ones(int(first[-1]), np.int64)
        for i, k in enumerate(kinds):
            if k[7]:
                often[first[i] : first[i + 1]] = np.frombuffer(k[7], np.int64)
        size = size[unit]
        reached = np.cumsum(size)
        place = np.arange(int(reached[-1]) if len(reached) else 0) + np.repeat(first[unit] - (reached - size), size)
        return np.where(good[:, None], per_doc[:, 1:], 0), digests, np.repeat(doc, size), pairs[place], often[place] * np.repeat(times, size)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner a worker and pair of files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


#: Rows of step 1: of a document (stripe is null), or of a stripe: its pairs (row of the stripe * n_b + b), how many documents hold each, which, and how often.
_ENCODED = pa.schema([("block", pa.int64()), ("stripe", pa.int32()), ("doc", pa.int32()), ("key", pa.int64()), ("numbers", pa.list_(pa.int64())), ("digest", pa.string()), ("cells", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary()), ("often", pa.binary())])
ENCODED = "block long, stripe int, doc int, key long, numbers array<long>, digest string, cells binary, runs binary, docs binary, often binary"


def _packed_docs(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(b: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _batch(rows: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows[f.name].cast(f.type) if f.name in rows else pa.nulls(n, f.type) for f in _ENCODED], schema=_ENCODED)


def encoded(docs: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """Step 1: rows of documents and of stripes."""
    chars = tokens.CHARS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for b in batches:
            sizes, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right")))
                yield from one(own, count, b.slice(at, to - at))
                at, count = to, count + 1

    def one(own: Aligner, block: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        numbers, digests, doc, pair, often = own.block(rows.column(1))
        n = rows.num_rows
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4), pa.int32()), pa.array(numbers.ravel()))
        yield _batch({"block": pa.array([block] * n), "doc": pa.array(np.arange(n)), "key": rows.column(0), "numbers": lists, "digest": pa.array(digests, pa.string())}, n)
        a, b = pair // own.n_b, pair % own.n_b
        stripe, cell = a % STRIPES, a // STRIPES * own.n_b + b
        order = np.lexsort((doc, cell, stripe))
        stripe, cell, doc, often = stripe[order], cell[order], doc[order], often[order]
        new = np.flatnonzero(np.r_[True, (stripe[1:] != stripe[:-1]) | (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])][: len(doc)])
        stripe, cell, doc, often = stripe[new], cell[new], doc[new], np.add.reduceat(often, new) if len(new) else often
        edges = np.searchsorted(stripe, np.arange(STRIPES + 1))
        made: list[tuple] = []
        for s in range(STRIPES):
            lo, hi = edges[s], edges[s + 1]
            if lo < hi:
                cells, runs = np.unique(cell[lo:hi], return_counts=True)
                made.append((s, pack_keys(cells.astype(np.uint64)), pack_counts(runs), _packed_docs(doc[lo:hi]), pack_counts(often[lo:hi])))
        if made:
            s, *parts = zip(*made)
            yield _batch({"block": pa.array([block] * len(s)), "stripe": pa.array(s)} | {k: pa.array(v, pa.binary()) for k, v in zip(("cells", "runs", "docs", "often"), parts)}, len(s))

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(work, ENCODED)


def align(work: Work, docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    path_a, path_b = path_a or tokens.default_path("byte_bpe_50k.json"), path_b or tokens.default_path("piece_bpe_32k.model")
    rows = work.table(encoded(spread(docs), key, text, path_a, path_b), "encoded")
    blocks = rows.where("stripe is null").select("block").distinct().count()
    most = max(1, -(-blocks // SLICE))
    striped = rows.where("stripe is not null").withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(most)).cast("int"))

    def summed(cells: list[bytes], runs: list[bytes]) -> np.ndarray:
        own = aligner(path_a, path_b)
        out = np.zeros((-(-own.n_a // STRIPES), own.n_b), np.int64)
        flat = out.reshape(-1)
        for c, r in zip(cells, runs):
            np.add.at(flat, unpack_keys(c).astype(np.int64), unpack_counts(r))
        return out

    def part(key: tuple, group: pa.Table) -> pa.Table:
        flat = summed(group["cells"].to_pylist(), group["runs"].to_pylist()).reshape(-1)
        cells = np.flatnonzero(flat)
        return pa.table({"stripe": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([pack_keys(cells.astype(np.uint64))], pa.binary()), "runs": pa.array([pack_counts(flat[cells])], pa.binary())})

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        counts = summed(group["cells"].to_pylist(), group["runs"].to_pylist())
        best, flat = counts.max(axis=1), counts.reshape(-1)
        cells = np.flatnonzero(flat)
        top = np.packbits(flat[cells] == best[cells // counts.shape[1]]).tobytes()
        return pa.table({"stripe": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([pack_keys(cells.astype(np.uint64))], pa.binary()), "runs": pa.array([pack_counts(flat[cells])], pa.binary()), "top": pa.array([top], pa.binary())})

    parts = striped.select("stripe", "slice", "cells", "runs").groupBy("stripe", "slice").applyInArrow(part, "stripe int, cells binary, runs binary")
    counts = work.table(parts.groupBy("stripe").applyInArrow(whole, "stripe int, cells binary, runs binary, top binary"), "counts")

    def score(key: tuple, links: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if links.num_rows:
            cells, count = unpack_keys(known["cells"][0].as_py()), unpack_counts(known["runs"][0].as_py())
            top = np.unpackbits(np.frombuffer(known["top"][0].as_py(), np.uint8), count=len(cells))
        for block, c, r, d, n in zip(*[links[k].to_pylist() for k in ("block", "cells", "runs", "docs", "often")]):
            at = np.repeat(np.searchsorted(cells, unpack_keys(c)), unpack_counts(r))
            doc, often = _unpacked(d, 4), unpack_counts(n)
            ids, place = np.unique(doc, return_inverse=True)
            best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.add.at(best, place, often * top[at])
            np.add.at(total, place, often * count[at])
            planes = zlib.compress(total.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
            out.append((block, _packed_docs(ids), pack_counts(best), planes))
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "docs", "best", "total"])

    dealt = counts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    scored = striped.select("stripe", "slice", "block", "cells", "runs", "docs", "often").groupBy("stripe", "slice").cogroup(dealt.groupBy("stripe", "slice")).applyInArrow(score, "block long, docs binary, best binary, total binary")

    def gather(key: tuple, own: pa.Table, scores: pa.Table) -> pa.Table:
        own = own.sort_by("doc")
        best, total = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, np.int64)
        for d, b, t in zip(*[scores[k].to_pylist() for k in ("docs", "best", "total")]):
            at = _unpacked(d, 4)
            best[at] += unpack_counts(b)
            total[at] += _unpacked(t, 8)
        numbers = own["numbers"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        return pa.table([own["key"], *[pa.array(numbers[:, i]) for i in range(4)], pa.array(best), pa.array(total), own["digest"]], names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"])

    texts = rows.where("stripe is null").select("block", "doc", "key", "numbers", "digest")
    out = texts.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(gather, "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string")
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(Work(spark, "alignment"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}

"""Removal of repeated 50-byte strings by difference-cover suffix arrays.

1. Equal texts are found by their digest: all but the first are removed whole, and go no further.
2. Every 50-byte window has an anchor, the leftmost of its 24-byte strings with the least hash; equal windows have equal
   anchors. Blocks of texts send the hashes of their anchors to shards (see routing), which answer which occur in two
   documents. The
   windows of all other anchors cannot repeat across documents.
3. Runs of windows with the same shared anchor go, as strings of bytes, to the shard of the anchor, so all copies of a
   window meet. A block sends a string once, with the least doc_id it has for it, and where it occurs. Windows of anchors
   that over HOT documents have go each by itself, by their own hash, so that the borders of a very common passage are
   dealt over many shards.
4. A shard sorts the suffixes of its strings by the difference cover modulo 3: the triples at places 1 and 2 modulo 3 are
   sorted and named, the names are sorted in the same way while they repeat and stand for fewer than 50 bytes, the other
   suffixes are sorted by a symbol and a rank, and merged. Neighbours with equal 50-byte prefixes are one class; its
   least doc_id decides which occurrences are removed.
5. Each text's removed windows are joined to spans, and what is left is hashed.

Hashes only choose what is compared; strings are equal if their bytes are. Defined results: a null text is empty, keeps
nothing and has no span. Texts of under 50 bytes are kept whole, and so is a text without an id, which comes neither before
nor after another: it loses nothing, and nothing is lost to it. Of equal texts the smallest id stays; a repeated row (same
id, same text) has the same result each time, otherwise ids are taken to be unique. A text of over PIECE_BYTES is worked on
in pieces, so no block grows with it; only its bytes and spans are in one task at the end. Columns beside those named are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import routing
from hushframe.llm.common import Work, lookup, mix, once, pack_counts, pack_keys, parts, size_of, small, unpack_counts, unpack_keys

#: Length of repeated strings, and of anchors.
LENGTH, ANCHOR = 50, 24
SPAN = LENGTH - ANCHOR + 1
#: Bytes of text of a block and of a shard's share; documents above which an anchor is split; suffixes sorted at once (few, as they stay in a core's cache).
BLOCK_BYTES, SHARD_BYTES, HOT, SORT_CHARS = 4 << 20, 8 << 20, 4096, 1 << 17
#: Bytes of a text over which its windows are worked on in pieces; windows whose anchors are found at once.
PIECE_BYTES, STEP = 4 << 20, 1 << 15
_BASE = 0x9E3779B97F4A7C15
_LOW, _MASK, _HIGH = np.uint64(40), np.uint64((1 << 40) - 1), np.uint64(((1 << 32) - 1) << 32)


# ---------------------------------------------------------------- suffix sorting


#: Codes up to which names come from a table instead of a sort.
TABLE = 1 << 18


def _names(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Dense ranks of codes below size, and the order of codes if it was found on the way."""
    if size <= max(TABLE, 2 * len(code)):
        seen = np.zeros(size, bool)
        seen[code] = True
        return (np.cumsum(seen) - 1)[code], None
    order = np.argsort(code)
    code = code[order]
    names = np.empty(len(code), np.int64)
    names[order] = np.cumsum(np.r_[False, code[1:] != code[:-1]])
    return names, order


def _stable(keys: np.ndarray, size: int) -> np.ndarray:
    """The stable order of keys below size. Where key and place share a word, that is sorted instead of an index."""
    bits = max(len(keys) - 1, 1).bit_length()
    if size >= 1 << (63 - bits):
        return np.argsort(keys, kind="stable")
    word = keys << bits
    word |= np.arange(len(keys))
    word.sort()
    word &= (1 << bits) - 1
    return word


def _joined(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> tuple[np.ndarray, int]:
    """Codes of pairs, and their bound; ranks of pairs where the codes would be too long."""
    if size_a * size_b >= 1 << 62:
        a, _ = _names(a, size_a)
        size_a = int(a.max(initial=0)) + 1
    code = a * size_b
    code += b
    return code, size_a * size_b


def suffix_array(t: np.ndarray, depth: int, covered: int = 1) -> np.ndarray:
    """Starts of the suffixes of t (integers > 0), in order of at least their first depth symbols' worth of bytes.

    covered: bytes that a symbol stands for. Suffixes that agree so far may stand in any order.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = t
    k = int(padded.max()) + 1
    n_ones = (n + 1 + (n % 3 == 1)) // 3  # a triple of zeros ends the first half
    ones, twos = slice(1, 3 * n_ones, 3), slice(2, n, 3)
    triple = [np.r_[padded[i:][ones], padded[i:][twos]] for i in range(3)]
    code, size = _joined(triple[0], k, triple[1], k)
    code, size = _joined(code, size, triple[2], k)
    names, order = _names(code, size)
    names += 1
    kinds = int(names.max())
    if kinds < len(names) and 3 * covered < depth:
        order = suffix_array(names, depth, 3 * covered)
        names[order] = np.arange(1, len(order) + 1)
    elif order is None:
        order = _stable(names, kinds + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[ones], rank[twos] = names[:n_ones], names[n_ones:]
    is_one = order < n_ones
    # the others: in order of what follows, then of their symbol
    zeros = 3 * order[is_one]
    zeros = zeros[_stable(padded[zeros], k)]
    order = 3 * order + np.where(is_one, 1, 2 - 3 * n_ones)
    if n % 3 == 1:  # without the triple of zeros
        real = order < n
        order, is_one = order[real], is_one[real]
    top = len(names) + 2
    # merge: against places 1 mod 3 by (symbol, rank), against 2 mod 3 by (symbol, symbol, rank)
    one, two = order[is_one], order[~is_one]
    z1, o1 = padded[zeros] * top + rank[zeros + 1], padded[one] * top + rank[one + 1]
    both = np.r_[zeros, two]
    code, size = _joined(padded[both], k, padded[both + 1], k)
    code, _ = _joined(code, size, rank[both + 2], top)
    z2, t2 = code[: len(zeros)], code[len(zeros) :]
    # equal prefixes within the depth may disagree in what follows; running maxima keep each list in order
    z1, o1, z2, t2 = (np.maximum.accumulate(c) for c in (z1, o1, z2, t2))
    before = np.empty(len(order), np.int64)
    before[is_one] = np.searchsorted(z1, o1)
    before[~is_one] = np.searchsorted(z2, t2)
    at = np.maximum.accumulate(before) + np.arange(len(order))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    out[at], free[at] = order, False
    out[free] = zeros
    return out


def classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of LENGTH bytes of strings, in order: their string, and their class (equal windows: the same)."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(s + b"\0" for s in strings) + bytes(LENGTH + 8), np.uint8)
    n = int(sizes.sum()) + len(strings)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(n, bool)
    inside[ends] = False
    used = np.bincount(text[:n][inside], minlength=256) > 0
    symbols = np.where(inside, (np.cumsum(used) + 1)[text[:n]], 1)  # few symbols, so that triples are named by a table
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    window = np.arange(n) + LENGTH <= ends[owner]
    order = suffix_array(symbols, LENGTH)
    order = order[window[order]]
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = np.ascontiguousarray(words[order + k]).view(np.uint64)[:, 0]
        same &= w[1:] == w[:-1]
    named = np.empty(n, np.int64)
    named[order] = np.cumsum(np.r_[0, ~same]) if len(order) else 0
    return owner[window], named[window]


# ---------------------------------------------------------------- anchors


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all strings of ANCHOR bytes, and the places of the anchors of all windows; in steps that stay in a core's cache.

    Of a hash 32 bits are compared, above the place, so that one minimum finds the leftmost of the least.
    """
    last = len(text) - LENGTH + 1
    hashes, places = np.empty(last + SPAN - 1, np.uint64), np.empty(last, np.uint32)
    for at in range(0, last, STEP):
        h = text[at : at + STEP + LENGTH - 1].astype(np.uint64)
        h += np.uint64(1)
        for k in (1, 2, 4, 8):
            h = h[:-k] * _power(k) + h[k:]
            h8 = h if k == 4 else None if k < 4 else h8
        h = h[: len(h) - 8] * _power(8) + h8[16:]  # 16 and 8 bytes
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hashes[at : at + len(h)] = h
        h &= _HIGH
        h |= np.arange(at, at + len(h), dtype=np.uint64)
        for k in (1, 2, 4, 8, SPAN - 16):
            h = np.minimum(h[:-k], h[k:])
        places[at : at + len(h)] = h  # the low half
    return hashes, places


class Block:
    """Texts of a block, the runs of windows with the same anchor (a run each), and the distinct anchors in order of shard and hash."""

    def __init__(self, docs: pa.Table, shards: int):
        order = np.argsort(docs.column("doc_id").to_numpy(), kind="stable")
        texts = docs.column("text").to_pylist()
        self.ids = docs.column("doc_id").to_numpy()[order]
        texts = [texts[i] or b"" for i in order]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.bytes = b"".join(texts)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes - docs.column("at").to_numpy()[order]  # of whole texts, in the block
        last = len(self.bytes) - LENGTH + 1
        if last <= 0:
            self.first = self.end = self.anchor = self.doc = self.of = np.empty(0, np.int64)
            self.hash = self.code = np.empty(0, np.uint64)
            return
        self.hash, place = anchors(np.frombuffer(self.bytes, np.uint8))
        inside = np.ones(last + 1, bool)  # windows that lie in one text
        over = (ends[:, None] - np.arange(1, LENGTH)).ravel()
        inside[over[(over >= 0) & (over < last)]] = False
        inside[last] = False
        new = np.r_[True, place[1:] != place[:-1]]
        # anchors never go back in a text, so each is that of one run
        self.first = np.flatnonzero(inside[:last] & (new | ~np.r_[False, inside[: last - 1]]))
        self.end = np.flatnonzero(inside[:last] & (~inside[1:] | np.r_[new[1:], True])) + LENGTH  # of the run's last window
        self.anchor = place[self.first].astype(np.int64)
        self.doc = np.searchsorted(ends, self.first, "right")
        found = mix(self.hash[self.anchor])
        code = ((found >> _LOW) % np.uint64(shards)) << _LOW | (found & _MASK)
        self.code, self.of = np.unique(code, return_inverse=True)

    def documents(self) -> np.ndarray:
        """In how many documents of the block each distinct anchor is."""
        if not len(self.code):
            return np.empty(0, np.int64)
        pair = np.unique(self.of * (len(self.ids) + 1) + self.doc)
        return np.bincount(pair // (len(self.ids) + 1), minlength=len(self.code))


def _ask(shards: int):
    each = routing.fan(shards)

    def work(docs: pa.Table) -> pa.Table:
        x, block = Block(docs, shards), docs.column("block")[0].as_py()
        known, edges = x.documents(), np.searchsorted(x.code >> _LOW, np.arange(shards + 1, dtype=np.uint64))
        return routing.table([(block, s, 0, sizes, pack_keys(x.code[i:j] & _MASK), [pack_counts(known[i:j])], 0) for s, i, j, sizes in routing.cells(edges, each)])

    return work


def _answer(hot: int):
    """Of each row's anchors: 0 if one document has it, 1 if several have, 2 if over hot have."""

    def work(rows: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in rows.column("keys").to_pylist()]
        code, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        docs = np.bincount(inverse, np.concatenate([unpack_counts(c) for (c,) in rows.column("values").to_pylist()]), len(code))
        said = (docs > 1).astype(np.int64) + (docs > hot)
        parts = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        empty = pa.array([b""] * len(keys), pa.binary())
        return pa.Table.from_arrays([rows.column("block"), rows.column("shard"), rows.column("kind"), rows.column("sizes"), empty, pa.array([[pack_counts(said[p])] for p in parts], pa.list_(pa.binary())), rows.column("n")], names=rows.column_names)

    return work


_STRINGS = "shard int, block long, strings binary, sizes binary, codes binary, firsts binary, which binary, docs binary, starts binary"


def _strings(shards: int):
    """The strings of a block that may repeat, by shard."""
    names = [c.split()[0] for c in _STRINGS.split(", ")]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows and answers.num_rows:
            x = Block(docs, shards)
            said = np.concatenate([unpack_counts(b) for _, (b,) in sorted(zip(answers.column("shard").to_pylist(), answers.column("values").to_pylist()))])
            kind = said[x.of]
            if kind.any():
                few, many = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
                code, start, end = mix(x.hash[x.anchor[few]]), x.first[few], x.end[few]
                if len(many):  # windows of very common anchors, each by itself
                    n = x.end[many] - LENGTH + 1 - x.first[many]
                    own = np.repeat(x.first[many] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    h = [mix(x.hash[own + k]) for k in (0, ANCHOR, LENGTH - ANCHOR)]
                    code = np.r_[code, mix(mix(h[0] * np.uint64(_BASE) + h[1]) * np.uint64(_BASE) + h[2])]
                    start, end = np.r_[start, own], np.r_[end, own + LENGTH]
                    order = np.argsort(start, kind="stable")
                    code, start, end = code[order], start[order], end[order]
                shard = ((code >> _LOW) % np.uint64(shards)).astype(np.int64)
                doc = x.doc[np.searchsorted(x.first, start, "right") - 1]
                block = docs.column("block")[0].as_py()
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    seen: dict[bytes, int] = {}
                    which = [seen.setdefault(x.bytes[s:e], len(seen)) for s, e in zip(start[part].tolist(), end[part].tolist())]
                    ids = x.ids[doc[part]].astype(np.int64)
                    _, least = np.unique(which, return_index=True)  # documents are in order, so the first has the least id
                    whole = list(seen)
                    rows.append((int(shard[part[0]]), block, b"".join(whole), np.array([len(s) for s in whole], "<u4").tobytes(), code[part][least].tobytes(), ids[least].tobytes(), np.array(which, "<u4").tobytes(), ids.tobytes(), (start[part] - x.starts[doc[part]]).tobytes()))
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    return work


_SPANS = "block long, docs binary, starts binary, ends binary"


def _decide(table: pa.Table) -> pa.Table:
    """A shard: which windows of each occurrence are removed, as spans of bytes."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    seen: dict[bytes, int] = {}
    place: list[np.ndarray] = []
    for strings, sizes in zip(columns["strings"], columns["sizes"]):
        ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)
        place.append(np.array([seen.setdefault(strings[s:e], len(seen)) for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())], np.int64))
    strings = list(seen)
    at = np.concatenate(place)
    first = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(first, at, np.concatenate([np.frombuffer(b, np.int64) for b in columns["firsts"]]))
    code = np.zeros(len(strings), np.uint64)
    code[at] = np.concatenate([np.frombuffer(b, np.uint64) for b in columns["codes"]])
    # windows of a string, in order: the least doc_id of their class
    counts = np.array([len(s) - LENGTH + 1 for s in strings], np.int64)
    offset = np.r_[0, np.cumsum(counts)]
    least = np.empty(offset[-1], np.int64)
    order, at, chars = np.argsort(code, kind="stable"), 0, counts + LENGTH
    sizes, codes = np.cumsum(chars[order]), code[order]
    while at < len(order):  # as many anchors as fit, all strings of each
        end = max(int(np.searchsorted(sizes, sizes[at] - chars[order[at]] + SORT_CHARS)), at + 1)
        end = int(np.searchsorted(codes, codes[end - 1], "right"))
        part = order[at:end]
        owner, named = classes([strings[i] for i in part])
        of_class = np.full(int(named.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(of_class, named, first[part][owner])
        least[np.repeat(offset[part] - np.r_[0, np.cumsum(counts[part])[:-1]], counts[part]) + np.arange(len(named))] = of_class[named]
        at = end
    rows = []
    for block, which, docs, starts, own in zip(columns["block"], columns["which"], columns["docs"], columns["starts"], place):
        string = own[np.frombuffer(which, "<u4")]
        docs, starts = np.frombuffer(docs, np.int64), np.frombuffer(starts, np.int64)
        n = counts[string]
        occurrence = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        gone = least[offset[string][occurrence] + within] < docs[occurrence]
        edge = np.r_[True, occurrence[1:] != occurrence[:-1]]
        begin = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
        stop = np.flatnonzero(gone & (np.r_[edge[1:], True] | ~np.r_[gone[1:], False]))
        if len(begin):
            o = occurrence[begin]
            rows.append((block, docs[o].tobytes(), (starts[o] + within[begin]).tobytes(), (starts[o] + within[stop] + LENGTH).tobytes()))
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "docs", "starts", "ends"])


def joined(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, those that touch joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]
    return list(zip(starts[new].tolist(), ends[last].tolist()))


_KEPT = "doc_id long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """The texts of a block that lose something: their spans and what is left."""
    ids, found, kept = [], [], []
    if docs.num_rows and spans.num_rows:
        doc, start, end = (np.concatenate([np.frombuffer(b, np.int64) for b in spans.column(c).to_pylist()]) for c in ("docs", "starts", "ends"))
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], start[order], end[order]
        texts = dict(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()))
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for d, s, e in zip(doc[np.r_[0, cuts]].tolist(), np.split(start, cuts), np.split(end, cuts)):
            whole, own = texts[d], joined(s, e)
            edges = [0, *[i for span in own for i in span], len(whole)]
            ids.append(d)
            found.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(whole[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
    cell = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(found, cell), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])


_PIECE = "doc_id long, at long, text binary"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts (doc_id, text) in pieces (see _PIECE) of PIECE_BYTES and the LENGTH - 1 bytes that follow, so that each window is in one piece."""
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for at in range(0, len(text) - LENGTH + 1, PIECE_BYTES):
                piece = text[at : at + PIECE_BYTES + LENGTH - 1]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([at], pa.int64()), pa.array([piece], pa.binary())], ["doc_id", "at", "text"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of pieces (see _SPANS), with each document as a block."""
    for b in batches:
        for docs, starts, ends in zip(*[b.column(c).to_pylist() for c in ("docs", "starts", "ends")]):
            doc, start, end = (np.frombuffer(x, np.int64) for x in (docs, starts, ends))
            order = np.argsort(doc, kind="stable")
            rows = [(int(doc[part[0]]), doc[part].tobytes(), start[part].tobytes(), end[part].tobytes()) for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "docs", "starts", "ends"])


def remove_repeats(work: Work, docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: all documents (doc_id, n_bytes, sha256, first: the smallest doc_id with the same text), and those whose text is the first of its kind and loses spans (doc_id, spans, kept)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    every, docs = docs, docs.where(F.col(key).isNotNull())  # a text without an id comes neither before nor after another
    named = work.table(docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha256")), "digests")
    groups = work.table(named.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sha256", "first"), "copies")
    named = work.table(lookup(named, groups, "sha256").select("doc_id", "n_bytes", "sha256", F.coalesce("first", "doc_id").alias("first")), "named")
    _, size = size_of(docs, text)
    blocks, shards = parts(size, BLOCK_BYTES), parts(size, SHARD_BYTES)
    single = once(work, docs.select(key, text), key, text)
    texts = single.select(F.col(key).cast("long").alias("doc_id"), body.alias("text")).where(F.octet_length("text") >= LENGTH).join(small(named.where("doc_id <> first").select("doc_id")), "doc_id", "left_anti")
    is_long = F.octet_length("text") > PIECE_BYTES + LENGTH
    pieces = work.table(texts.where(is_long).mapInArrow(_split, _PIECE), "pieces")
    n_pieces = pieces.count()
    dealt = texts.where(~is_long).select("doc_id", F.lit(0).cast("long").alias("at"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))
    whole = dealt  # what is cut in the end
    if n_pieces:  # pieces are dealt to blocks of their own, with numbers below 0
        dealt = dealt.unionByName(pieces.withColumn("block", F.lit(-1) - F.pmod(F.xxhash64("doc_id", "at"), F.lit(n_pieces))))
    asked = work.table(dealt.groupBy("block").applyInArrow(_ask(shards), routing.ROW), "asked")
    work.release()
    answers, _ = routing.ask(asked, shards, _answer(HOT), lambda df: work.table(df, "answers"))
    work.drop(asked)
    work.release()
    strings = work.table(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_strings(shards), _STRINGS), "strings")
    work.release()
    spans = work.table(strings.groupBy("shard").applyInArrow(_decide, _SPANS), "spans")
    work.drop(strings)
    work.release()
    cut = whole.groupBy("block").cogroup(spans.where("block >= 0").groupBy("block")).applyInArrow(_cut, _KEPT)
    if n_pieces:
        of_pieces = work.table(spans.where("block < 0").mapInArrow(_by_document, _SPANS), "spans-of-long-texts")
        long = texts.where(is_long).select("doc_id", "text", F.col("doc_id").alias("block"))
        cut = cut.unionByName(long.groupBy("block").cogroup(of_pieces.groupBy("block")).applyInArrow(_cut, _KEPT))
    nameless = every.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha256"), F.lit(None).cast("long").alias("first"))
    return named.unionByName(nameless.select(*named.columns)), cut


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    named, cut = remove_repeats(Work(spark, "substrings"), docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    cut = cut.select("doc_id", removed.alias("r"), F.size("spans").cast("long").alias("s"), F.sha2("kept", 256).alias("k"))
    whole = F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return named.join(cut, "doc_id", "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, F.lit(nothing)).otherwise(F.coalesce("k", "sha256")).alias("kept_sha256"),
    )


QUERIES = {"op2_suffix_array": op2_suffix_array}
ORACLES: dict[str, str] = {}

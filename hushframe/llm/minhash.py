"""Near-duplicates by MinHash with tensored banding, confirmed on full sets.

Two collections of sub-keys are made of few minhashes: N_A of ROWS_A and N_B of ROWS_B hashes each. Every pair of an
a-sub-key and a b-sub-key is the key of a table, so N_A * N_B tables of ROWS_A + ROWS_B hashes come from N_A * ROWS_A +
N_B * ROWS_B hash functions (68 in place of 800). Two sets of similarity s meet in a table with probability
(1 - (1 - s^ROWS_A)^N_A) * (1 - (1 - s^ROWS_B)^N_B): 0.9996 at 0.75, over 0.99999 from 0.81.

1. Texts of equal shingle sets are one set, named by its smallest id, before any key is made.
2. Each table's bucket is a star around its smallest id (a streaming window, nothing is collected; what a batch of sets
   shares is cut down to its smallest id before the shuffle); the stars' connected components are groups of sets that
   might be linked.
3. A group's sets are compared exactly, all with all, by tiles of at most CHUNK x CHUNK sets: a large group is spread over
   many tasks (about PARTS * PARTS / 2 at least), and a tile returns a spanning forest of its links, not its pairs.
4. Connected components of the links.

Defined results: a text of no words (null, empty, white space) has no shingles and is linked with nothing, itself included
in its own component; with fewer than five words the whole sequence is one shingle. A document without an id can't name a
component: its component is null, it is linked with nothing and kept. Shingles are 64-bit hashes, sets of
them are named by 128-bit hashes. A repeated row (same id, same text) has the same result each time; otherwise ids are
taken to be unique. A very long text is one set in one worker (some 60 bytes a word). Columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.common import Work, as_long, give_back, lookup, mix, once, own_columns, small, spread, word_hashes
from hushframe.llm.components import components

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
N_A, ROWS_A, N_B, ROWS_B = 16, 3, 10, 2
#: Sets of a tile's side, at most; of groups that could be one tile or few, a side of FINE, but no more than PARTS sides; shared shingles that are multiplied at once.
CHUNK, FINE, PARTS, SLICE = 1024, 128, 16, 8192
#: Sets whose table keys are made at once.
AT_ONCE = 1024

_seeds = np.random.default_rng(20240229).integers(0, 1 << 63, (2, N_A * ROWS_A + N_B * ROWS_B), dtype=np.uint64)
_XOR, _TIMES = _seeds[0] << np.uint64(1), _seeds[1] | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < WORDS:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), len(w))], np.uint64)
    h = w[: len(w) - WORDS + 1].copy()
    for k in range(1, WORDS):
        h *= _BASE
        h += w[k : len(w) - WORDS + 1 + k]
    return np.unique(mix(h))


def sub_keys(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two collections of sub-keys of a set."""
    lows = np.array([((sets ^ x) * t).min() for x, t in zip(_XOR, _TIMES)], np.uint64)
    a, b = lows[: N_A * ROWS_A].reshape(N_A, ROWS_A), lows[N_A * ROWS_A :].reshape(N_B, ROWS_B)

    def joined(m: np.ndarray) -> np.ndarray:
        out = m[:, 0].copy()
        for k in range(1, m.shape[1]):
            out = mix(out) * _BASE + m[:, k]
        return mix(out)

    return joined(a), joined(b)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n (set size), name (of the set; null if empty), a, b (sub-keys)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, keys_a, keys_b = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                a, c = sub_keys(s) if len(s) else (np.empty(0, np.uint64),) * 2
                keys_a.append(as_long(a))
                keys_b.append(as_long(c))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(k) for k in x])], pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), lists(keys_a), lists(keys_b)], ["id", "n", "name", "a", "b"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(work, "id long, n long, name binary, a array<long>, b array<long>")


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of links between places, those that a spanning forest needs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in pairs.tolist():
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Links (i, j) between two lists of sets, or within one (right is None): exact, then cut down to a spanning forest."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[inverse] > 1
    column, row = (np.cumsum(count > 1) - 1)[inverse[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    k, n = len(left), int((count > 1).sum())
    m = len(sets) - k if right is not None else k
    both = np.zeros((k, m), np.float32)
    for at in range(0, n, SLICE):
        lo, hi = np.searchsorted(column, [at, at + SLICE])
        block = np.zeros((len(sets), min(SLICE, n - at)), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        both += block[:k] @ (block[k:] if right is not None else block).T
    inner = np.rint(both).astype(np.int64)
    union = sizes[:k, None] + (sizes[k:] if right is not None else sizes)[None, :] - inner
    linked = 100 * inner >= PERCENT * union
    i, j = np.nonzero(linked)
    if right is None:
        i, j = i[i < j], j[i < j]
    else:
        j = j + k
    return _forest(np.stack([i, j], axis=1))


def links(work: Work, docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """(src, dst) of links that span each group; members: id, root."""
    sizes = members.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") > FINE)
    everyone = members.union(members.select("root", "root").distinct())
    sides = F.greatest(F.ceil(F.col("n") / CHUNK), F.least(F.ceil(F.col("n") / FINE), F.lit(PARTS)))
    placed = work.table(lookup(everyone, sizes.select("root", sides.cast("int").alias("c")), "root").select("id", "root", F.coalesce("c", F.lit(1)).alias("c")), "placed")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).join(small(placed), "id")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t.as_py()).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("root"), b.column("c"), sets], ["id", "root", "c", "shingles"])

    tiles = (
        texts.select("id", "root", "c", "text").mapInArrow(as_sets, "id long, root long, c int, shingles binary")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "shingles")
        .repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "own", "id")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: tuple | None = None
        ids: list[int] = []
        sets: list[np.ndarray] = []
        own: list[int] = []
        found: list[tuple[int, int]] = []

        def done() -> None:
            if len(ids) > 1:
                cut = own.count(own[0])
                pairs = tile_links(sets, None) if tile[1] == tile[2] else tile_links(sets[:cut], sets[cut:]) if cut < len(ids) else []
                found.extend((ids[i], ids[j]) for i, j in pairs)

        for b in batches:
            for root, lo, hi, o, i, s in zip(*[c.to_pylist() for c in b.columns]):
                if (root, lo, hi) != tile:
                    done()
                    tile, ids, sets, own = (root, lo, hi), [], [], []
                ids.append(i)
                sets.append(np.frombuffer(s, np.uint64))
                own.append(o)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["src", "dst"])
                found.clear()
        done()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["src", "dst"])
        ids.clear()
        sets.clear()
        give_back(words=True)

    return tiles.mapInArrow(compare, "src long, dst long")


def table_keys(reps: DataFrame) -> DataFrame:
    """table_key, id and centre of reps (id, a, b): a row for each of the tables; centre is null.

    Of the ids of a batch (AT_ONCE sets) that share a key, only the least goes on under it; each other one has a row with that least id as
    its centre, once, under a key of its own. So a key that very many sets share is cut down before it is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            ids = x.column("id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, n = ids[order], len(ids)
            a, b = (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)[order] for c in (x.column("a"), x.column("b")))
            table = np.arange(a.shape[1] * b.shape[1], dtype=np.uint64).reshape(a.shape[1], b.shape[1])
            keys = mix(mix(a)[:, :, None] * _BASE + b[:, None, :] + mix(table + _BASE)[None]).ravel()
            doc = np.repeat(np.arange(n), table.size)
            by = np.argsort(keys, kind="stable")
            keys, doc = keys[by], doc[by]
            new = np.r_[True, keys[1:] != keys[:-1]]
            first = doc[new]
            again = np.unique((doc * n + np.repeat(first, np.diff(np.r_[np.flatnonzero(new), len(keys)])))[~new])
            own, centre = ids[again // n], ids[again % n]
            apart = own != centre
            own, centre = own[apart], centre[apart]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[as_long(keys[new]), as_long(mix(own.view(np.uint64)))]), pa.array(np.r_[ids[first], own]),
                pa.array(np.r_[np.zeros(len(first), np.int64), centre], mask=np.r_[np.ones(len(first), bool), np.zeros(len(own), bool)]),
            ], ["table_key", "id", "centre"])

    return reps.select("id", "a", "b").mapInArrow(work, "table_key long, id long, centre long")


def near_duplicates(work: Work, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and kept of every document."""
    made = work.table(sketches(spread(docs), key, text), "sketches")
    all_sketches = made.where("id is not null")
    copies = all_sketches.where("name is not null").groupBy("name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("name", "first")
    copies = work.table(copies, "copies")
    named = work.table(lookup(all_sketches.select("id", "n", "name"), copies, "name").select("id", "n", F.coalesce("first", "id").alias("rep")), "named")
    reps = all_sketches.where("n > 0").join(small(named.where("id <> rep").select("id")), "id", "left_anti")
    bucket = Window.partitionBy("table_key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = table_keys(reps).withColumn("centre", F.coalesce("centre", F.first("id").over(bucket))).where("id <> centre").select(F.col("id").alias("src"), F.col("centre").alias("dst")).distinct()
    groups = components(work, work.table(stars, "candidates"))
    work.drop(copies)
    work.release()
    linked = components(work, work.table(links(work, docs, groups, key, text), "links"))
    work.release()
    out = lookup(named, linked.select(F.col("id").alias("rep"), "root"), "rep").withColumn("component_id", F.coalesce("root", "rep"))
    nameless = made.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component_id"))
    out = out.select("id", "n", "component_id").unionByName(nameless)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(Work(spark, "minhash"), docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the smallest doc_id, of repeated rows (same doc_id and text) one."""
    work = Work(spark, "minhash")
    docs = once(work, docs)
    gone = near_duplicates(work, docs).where("not kept").select("doc_id")
    return docs.join(small(work.table(gone, "gone")), "doc_id", "left_anti").select(*own_columns(docs))


def oracle(source: str = "documents") -> str:
    """DuckDB SQL: exact sets, all pairs that share a shingle, and a recursive closure."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS x(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x WHERE r.root < e.y),
c AS (SELECT x, min(root) AS root FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root::BIGINT AS component_id, doc_id = root AS kept FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n USING (doc_id)
"""


QUERIES = {"op1_minhash": op1_minhash}
ORACLES = {"op1_minhash": oracle()}

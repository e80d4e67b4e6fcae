"""Hard-negative mining by one-dimensional distance keys.

Largest inner product becomes nearest neighbour: a row x is augmented by sqrt(M^2 - |x|^2), where M is the largest norm, and
an anchor q by zero, so that |q - x|^2 = |q|^2 + M^2 - 2 <q, x>. Each row has the key (its nearest pivot, its distance to it);
rows are dealt and sorted by their keys and written in blocks of neighbouring keys. A row at distance d from an anchor has a
key within d of the anchor's own distance to that pivot. So a search for the nearest scans, around each pivot, the blocks
whose interval of keys meets the anchor's distance plus or minus a radius. The radius grows from round to round: to the
distance of the worst of the best rows found, which certifies them, or to GROWTH times itself while there are too few. A search may
begin at a distance (rows of a score over its cap are left out) and ends at the distance of its least score.

1. An anchor's positives: the first of its label.
2. For each positive, the first of other labels whose score lies between SHARE percent of the positive's and that itself.

Pivots are a sample of PIVOTS rows, those of the smallest hashes; all rows are indexed, and what is found is exact, whatever
the pivots are. Anchors go in groups, a group and a block meet in one task by a join of intervals, and what a task returns
of a search is its best rows, none below the worst of those known. Of many rows with the same vector (one key), blocks hold
ranges of ids.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Components
become floor(256 x), saturated at 64 bits; vectors of different lengths are taken as if they went on with zeros. Products
are exact; one that does not fit 64 bits is held as the nearest number that does. A repeated row counts once; of rows that
share a vec_id and differ, the one of the least (label, vector). A positive of negative score has no negatives. Without
anchors, other labels or rows, there are no rows. Columns beside those named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.common import Work, parts, small, spread

#: Anchors are rows whose id is divisible by EVERY; positives of one, and negatives of each positive.
EVERY, BEST = 100, 5
#: The least score of a negative, in percent of the positive's.
SHARE = 80
#: A component x becomes floor(SCALE * x).
SCALE = 256
PIVOTS = 32
#: Rows of a block, searches of a group, groups that one task scans a block for, and scores that are looked at at once.
BLOCK, GROUP, TOGETHER, AT_ONCE = 8192, 4096, 8, 1 << 21
#: The first radius, as a share of M; by how much it grows while there are too few rows; what distances may be off by rounding, as a share of M.
FIRST, GROWTH, SLACK = 1 / 16, 3, 1e-6
LEAST, MOST = -(2**63), 2**63 - 1

_ROWS = "id long, label long, n2 double, vec binary, pivot int, dist double, reach binary"
_OPEN = ("anchor", "slot", "same", "cap", "floor", "kth", "before", "radius", "label", "n2", "vec", "reach")


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label and v (whole numbers) of the rows that take part."""
    df = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where("id is not null and label is not null and v is not null")
    df = df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    return df.withColumn("v", F.transform("v", lambda x: F.floor(SCALE * x.cast("double")).cast("long")))


def unique(work: Work, df: DataFrame) -> DataFrame:
    """One row an id; only rows whose id is repeated are shuffled."""
    again = work.table(df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        return df
    single, many = (df.join(small(again), "id", how) for how in ("left_anti", "left_semi"))
    return single.unionByName(many.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))


class Space:
    """What is known of all vectors: their length, bytes of a component, and M^2 (as a whole number where it is small)."""

    def __init__(self, df: DataFrame):
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        r = df.agg(F.max(F.size("v")).alias("dim"), F.max(size).alias("m2"), F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0))).alias("top")).first()
        self.dim, self.m2, top = int(r["dim"] or 0), float(r["m2"] or 0.0), float(r["top"] or 0.0)
        self.m = math.sqrt(self.m2)
        self.kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
        # sums of products are exact in a type that holds |q| |x| <= M^2
        self.type = np.float32 if self.m2 < 2**24 else np.float64 if self.m2 < 2**53 else object

    def matrix(self, vectors: pa.Array) -> np.ndarray:
        """Vectors as rows, with zeros where they end."""
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(vectors), self.dim), np.int64)
        out[np.arange(self.dim)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        return out

    def read(self, b: bytes) -> np.ndarray:
        return np.frombuffer(b, self.kind).reshape(-1, self.dim) if self.dim else np.zeros((0, 0), np.int64)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a.astype(self.type) @ b.astype(self.type).T
        return np.clip(out, LEAST, MOST).astype(np.int64) if self.type is object else np.rint(out).astype(np.int64)

    def distance(self, n2, score):
        """From a point of squared norm n2 (augmented by zero) to a row of a score."""
        return np.sqrt(np.maximum(np.asarray(n2, np.float64) + self.m2 - 2.0 * np.asarray(score, np.float64), 0.0))


def keyed(df: DataFrame, space: Space, pivots: np.ndarray) -> DataFrame:
    """Rows with their squared norm, vector as bytes, nearest pivot and distance to it; anchors (reach) with their distances to all pivots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = lambda x: np.sqrt(np.maximum(space.m2 - np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)), 0.0))
        for b in batches:
            x = space.matrix(b.column(2))
            wide = x.astype(np.float64)
            n2, inner = np.einsum("ij,ij->i", wide, wide), wide @ pivots.astype(np.float64).T
            near = np.sqrt(np.maximum(2 * space.m2 - 2 * (inner + up(x)[:, None] * up(pivots)[None, :]), 0.0))
            pivot = near.argmin(axis=1)
            reach, ids = np.sqrt(np.maximum(n2[:, None] + space.m2 - 2 * inner, 0.0)), b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(n2), pa.array([r.tobytes() for r in x.astype(space.kind)], pa.binary()), pa.array(pivot, pa.int32()), pa.array(near[np.arange(len(x)), pivot]),
                pa.array([r.tobytes() if i % EVERY == 0 else None for i, r in zip(ids.tolist(), reach)], pa.binary()),
            ], [c.split()[0] for c in _ROWS.split(", ")])

    return df.select("id", "label", "v").mapInArrow(work, _ROWS)


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows of one pivot with neighbouring distances: block, pivot, lo, hi, ids, labels and vecs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            pivot, out = b.column("pivot").to_numpy(), []
            for run in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(pivot)) + 1):
                for at in range(0, len(run), BLOCK):
                    own = b.slice(int(run[at]), len(run[at : at + BLOCK]))
                    dist = own.column("dist").to_numpy()
                    out.append((name, int(pivot[run[at]]), float(dist.min()), float(dist.max()), own.column("id").to_numpy().tobytes(), own.column("label").to_numpy().tobytes(), b"".join(own.column("vec").to_pylist())))
                    name += 1
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["block", "pivot", "lo", "hi", "ids", "labels", "vecs"])

    dealt = rows.select("id", "label", "vec", "pivot", "dist").repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    return dealt.mapInArrow(work, "block long, pivot int, lo double, hi double, ids binary, labels binary, vecs binary")


def groups(searches: DataFrame, n_pivots: int, slack: float) -> DataFrame:
    """Groups of open searches: group, spans (pivot, from, to: the keys that they ask for), and the searches as they are."""
    types = dict(searches.dtypes)
    fields = ", ".join(f"{c}: {types[c]}" for c in _OPEN)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                own = b.slice(at, GROUP)
                reach = np.frombuffer(b"".join(own.column("reach").to_pylist()), np.float64).reshape(-1, n_pivots)
                radius = own.column("radius").to_numpy()[:, None] + slack
                spans = pa.array([[{"pivot": p, "from": float(a), "to": float(z)} for p, (a, z) in enumerate(zip((reach - radius).min(axis=0), (reach + radius).max(axis=0)))]], pa.list_(pa.struct([("pivot", pa.int32()), ("from", pa.float64()), ("to", pa.float64())])))
                items = pa.StructArray.from_arrays([own.column(c) for c in _OPEN], list(_OPEN))
                yield pa.RecordBatch.from_arrays([pa.array([name]), spans, pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), items)], ["group", "spans", "searches"])
                name += 1

    order = searches.repartitionByRange("pivot", "dist", "anchor").sortWithinPartitions("pivot", "dist", "anchor").select(*_OPEN)
    return order.mapInArrow(work, f"group long, spans array<struct<pivot: int, from: double, to: double>>, searches array<struct<{fields}>>")


def best_of(scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's BEST columns by score, of equal ones by id, among those that are ok."""
    n = scores.shape[1]
    if n > BEST:
        masked = np.where(ok, scores, LEAST)
        ok = ok & (masked >= np.partition(masked, n - BEST, axis=1)[:, n - BEST : n - BEST + 1])
    r, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < BEST
    return r[first], c[first]


def scan(space: Space, asked: pa.Table, block: dict, slack: float) -> list[tuple[np.ndarray, ...]]:
    """What the searches of a table find in a block: (anchor, slot, score, id)."""
    column = lambda c: asked[c].to_numpy()
    pivot, n2 = block["pivot"], column("n2")
    reach = np.frombuffer(b"".join(asked["reach"].to_pylist()), np.float64).reshape(asked.num_rows, -1)[:, pivot]
    near, far = np.maximum(np.maximum(block["lo"] - reach, reach - block["hi"]), 0.0), reach + block["hi"]
    begin = np.where(column("cap") == MOST, 0.0, space.distance(n2, column("cap")))
    need = np.flatnonzero((near <= column("radius") + slack) & (near > column("before") + slack) & (far >= begin - slack))
    if not len(need):
        return []
    ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
    anchors, place = np.unique(column("anchor")[need], return_index=True)
    vectors = asked["vec"].take(pa.array(need[place])).to_pylist()
    rows, out, step = space.read(block["vecs"]) if space.dim else np.zeros((len(ids), 0)), [], max(1, AT_ONCE // len(ids))
    queries = space.read(b"".join(vectors)) if space.dim else np.zeros((len(vectors), 0))
    at = np.searchsorted(anchors, column("anchor")[need])
    order = np.argsort(at, kind="stable")
    need, at = need[order], at[order]
    for k in range(0, len(need), step):
        own, who = need[k : k + step], at[k : k + step]
        first = who[0]
        scores = space.products(queries[first : who[-1] + 1], rows)[who - first]
        floor = np.maximum(column("floor")[own], column("kth")[own])[:, None]
        ok = (scores <= column("cap")[own][:, None]) & (scores >= floor) & ((labels[None, :] == column("label")[own][:, None]) == column("same")[own][:, None]) & (ids[None, :] != column("anchor")[own][:, None])
        r, c = best_of(scores, ok, ids)
        out.append((column("anchor")[own][r], column("slot")[own][r], scores[r, c], ids[c]))
    return out


class Index:
    """Rows in blocks of neighbouring distance keys, and the anchors among them."""

    def __init__(self, work: Work, rows: DataFrame, key: str, vector: str, label: str):
        self.work = work
        df = work.table(unique(work, usable(spread(rows), key, vector, label)), "rows")
        self.space = Space(df)
        chosen = [r["v"] for r in df.select("v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
        self.pivots = self.space.matrix(pa.array(chosen or [[]], pa.list_(pa.int64())))
        rows = work.table(keyed(df, self.space, self.pivots), "keyed")
        self.anchors = work.table(rows.where("reach is not null").withColumnRenamed("id", "anchor"), "anchors")
        self.blocks = work.table(blocks(rows), "blocks")
        self.slack = SLACK * self.space.m

    def search(self, wanted: DataFrame, name: str) -> DataFrame:
        """(anchor, slot, score, id, rank) of searches (anchor, slot, same, cap, floor): the BEST rows of the anchor's label, or of others, with scores of floor .. cap."""
        space, work, slack = self.space, self.work, self.slack
        first = {"kth": F.lit(LEAST).cast("long"), "before": F.lit(-1.0) - 2 * slack, "radius": F.lit(FIRST * space.m)}
        state = work.table(wanted.join(self.anchors, "anchor").withColumns(first), name)
        found = None
        while True:
            asked = work.table(groups(state, len(self.pivots), slack), f"{name}-groups")
            together = parts(asked.count(), TOGETHER)
            spans = asked.select("group", F.pmod(F.xxhash64("group"), F.lit(together)).alias("part"), F.explode("spans").alias("s")).select("group", "part", "s.*")
            tiles = spans.join(self.blocks.select("block", "pivot", "lo", "hi"), "pivot").where("`from` <= hi and `to` >= lo").select("group", "part", "block")
            tiles = work.table(tiles, f"{name}-tiles")
            left = tiles.join(asked.select("group", "searches"), "group").select("block", "part", "searches").groupBy("block", "part")
            right = self.blocks.join(tiles.select("block", (F.col("part") + 0).alias("part")).distinct(), "block").groupBy("block", "part")

            def meet(key: tuple, searches: pa.Table, block: pa.Table) -> pa.Table:
                own, out = block.to_pylist()[0], []
                for row in searches["searches"].combine_chunks():
                    out += scan(space, pa.Table.from_struct_array(row.values), own, slack)
                made = [np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(4)]
                return pa.table([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int32()), pa.array(made[2], pa.int64()), pa.array(made[3], pa.int64())], names=["anchor", "slot", "score", "id"])

            new = left.cogroup(right).applyInArrow(meet, "anchor long, slot int, score long, id long")
            every = new if found is None else new.unionByName(found.select("anchor", "slot", "score", "id"))
            place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
            found = work.table(every.withColumn("rank", place).where(F.col("rank") <= BEST), f"{name}-found")
            known = found.where(F.col("rank") == BEST).select("anchor", "slot", F.col("score").alias("worst"))
            far = lambda score: F.sqrt(F.greatest(F.col("n2") + space.m2 - 2.0 * F.col(score).cast("double"), F.lit(0.0)))
            end = F.when(F.col("floor") == LEAST, F.sqrt("n2") + space.m).otherwise(far("floor"))
            done = F.when(F.col("worst").isNull(), end).otherwise(F.least(end, far("worst")))
            radius = F.when(F.col("worst").isNotNull(), F.col("done")).otherwise(F.least(GROWTH * F.col("radius"), F.col("done")))
            after = state.join(known, ["anchor", "slot"], "left").withColumn("done", done).where("radius < done").withColumns({"before": F.col("radius"), "radius": radius, "kth": F.coalesce("worst", F.col("kth"))})
            state = work.table(after.drop("worst", "done"), name)
            if state.isEmpty():
                return found


def mine(work: Work, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    index = Index(work, rows, key, vector, label)
    search = lambda df, slot, same, cap, floor: df.select("anchor", slot.cast("int").alias("slot"), F.lit(same).alias("same"), cap.cast("long").alias("cap"), floor.cast("long").alias("floor"))
    positives = index.search(search(index.anchors.select("anchor"), F.lit(0), True, F.lit(MOST), F.lit(LEAST)), "positives").select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("p"))
    least = F.expr(f"(cast({SHARE} as decimal(3, 0)) * cast(p as decimal(19, 0)) + 99) div 100")
    negatives = index.search(search(positives.where("p >= 0"), F.col("slot"), False, F.col("p"), least), "negatives")
    return positives.join(negatives, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return mine(Work(spark, "negatives"), df)


#: DuckDB SQL: every anchor with every row.
ORACLE = f"""
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM e),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {BEST}),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {SHARE} * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {BEST}
"""
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": ORACLE}

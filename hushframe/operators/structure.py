"""Columns, unions and partitions of private frames."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.plans.frame import Key, PrivateFrame, Step, _partitions
from hushframe.plans.shared import written
from hushframe.privacy import SUBSTITUTE, PrivacyError, Usage, common, composed


def to_dataframe(frame: PrivateFrame, names: Sequence[str]) -> PrivateFrame:
    """The columns under new names, one for each."""
    if len(names) != len(frame.props):
        raise PrivacyError(f"{len(frame.props)} columns need as many names")
    out = frame.derive({n: F.col(o) for o, n in zip(frame.props, names)}, dict(zip(names, frame.props.values())))
    return out.same_rows(out.df.select(*names), out.props)


def index(frame: PrivateFrame, names: Sequence[str] | str | None = None, indices: Sequence[int] | None = None, mask: Sequence[bool] | None = None, key=None) -> PrivateFrame:
    """Columns by names, places or a mask; or, of a partitioned frame, the part of a key."""
    if key is not None:
        key = key if isinstance(key, tuple) else (key,)
        if not frame.keys or len(key) != len(frame.keys) or any(v not in k.categories for k, v in zip(frame.keys, key)):
            raise PrivacyError(f"there is no part {key}")
        where = F.lit(True)
        for k, v in zip(frame.keys, key):
            where = where & (F.col(k.name) == F.lit(v))
        steps: dict[int, list] = {}
        for k, v in zip(frame.keys, key):
            steps.setdefault(k.partition, []).append(v)
        return frame.new_rows(frame.df.where(where), keys=(), path=frame.path + tuple((p, tuple(v)) for p, v in steps.items()))
    have = list(frame.props)
    if names is not None:
        wanted = [names] if isinstance(names, str) else list(names)
    elif indices is not None:
        wanted = [have[i] for i in indices]
    elif mask is not None and len(mask) == len(have):
        wanted = [n for n, m in zip(have, mask) if m]
    else:
        raise PrivacyError("index needs names, indices or a mask of all columns")
    props = {n: frame.of(n) for n in wanted}
    extra = [k.name for k in frame.keys if k.name not in wanted]
    return frame.same_rows(frame.df.select(*wanted, *extra), props)


def column_bind(*frames: PrivateFrame) -> PrivateFrame:
    """Columns of frames that share their rows, however each was derived: their steps are taken again, one frame after the other, on the rows all began with."""
    first, props = frames[0], {}
    for f in frames:
        if f.identity != first.identity or f.base is not first.base:
            raise PrivacyError("only columns of the same rows can be bound; rows are never matched by position")
        for n, p in f.props.items():
            if n in props:
                raise PrivacyError(f"two columns are named {n}")
            props[n] = p
    mark = uuid.uuid4().hex[:8]
    names = {(i, n): f"__bound_{mark}_{i}_{n}" for i, f in enumerate(frames) for n in f.props}

    def step(df: DataFrame) -> DataFrame:
        own = df.columns
        df = df.withColumns({f"__base_{mark}_{c}": F.col(f"`{c}`") for c in own})
        for i, f in enumerate(frames):
            for s in f.steps:
                df = s.apply(df)
            df = df.withColumns({names[i, n]: F.col(f"`{n}`") for n in f.props}).withColumns({c: F.col(f"`__base_{mark}_{c}`") for c in own})
        df = df.withColumns({n: F.col(f"`{at}`") for (_, n), at in names.items()})
        return df.drop(*names.values(), *[f"__base_{mark}_{c}" for c in own])

    keys = [k.name for k in first.keys if k.name not in props]
    return replace(first, df=step(first.base).select(*props, *keys), props=props, rows=first.base, steps=(Step(step, frozenset(props)),))


def reshape(values, shape: Sequence[int], symmetric: bool = False) -> np.ndarray | dict[int, np.ndarray]:
    """A released row as an array; symmetric: the upper triangle of a square matrix, row by row. Of several rows, one array each, by place."""
    v = np.asarray(values)
    if v.ndim == 2 and len(v) > 1:
        return {i: reshape(row, shape, symmetric) for i, row in enumerate(v)}
    v = v.ravel()
    if symmetric:
        n = shape[0]
        if len(shape) > 2 or shape[-1] != n or len(v) != n * (n + 1) // 2:
            raise PrivacyError("an upper triangle of this length gives no such matrix")
        out = np.empty((n, n), v.dtype)
        at = np.triu_indices(n)
        out[at] = v
        out.T[at] = v
        return out
    if len(shape) > 2 or math.prod(shape) != len(v):
        raise PrivacyError("a row of this length gives no such matrix")
    return v.reshape(tuple(shape))


def filter_rows(frame: PrivateFrame, mask: str) -> PrivateFrame:
    """Rows where a boolean column is true; their number is unknown afterwards."""
    if frame.of(mask).kind != "bool":
        raise PrivacyError("a mask is one boolean column")
    return frame.new_rows(frame.df.where(F.col(mask)), n=None, not_empty=False)


def partition_by(frame: PrivateFrame, by: Sequence[str] | str) -> PrivateFrame:
    """Parts by the declared categories of columns: all combinations, empty ones too; undeclared values are in none."""
    names = [by] if isinstance(by, str) else list(by)
    keys, number = [], next(_partitions)
    for n in names:
        p = frame.of(n)
        if p.categories is None:
            raise PrivacyError(f"the categories of {n} must be declared; clamp it first")
        keys.append(Key(n, tuple(p.categories), number))
    twice = 2 if frame.definition.neighboring == SUBSTITUTE else 1
    return frame.new_rows(frame.df, keys=(*frame.keys, *keys), n=None, not_empty=False, stability=frame.stability * twice)


def even_lengths(n: int, k: int) -> list[int]:
    """Lengths of k even parts; the first get the remainder."""
    return [n // k + (i < n % k) for i in range(k)]


def partition_even(frame: PrivateFrame, num_partitions: int, order_by: str) -> PrivateFrame:
    """Parts of even, known lengths along a column's order: key part, 0 .. num_partitions - 1. The rows are numbered and written here.

    The order is taken to be public, as a row's place is: an individual's data doesn't move others from part to part.
    """
    if frame.n is None:
        raise PrivacyError("even parts need a known number of records")
    n, k = frame.n, num_partitions
    numbered = numbering(frame.df, [order_by])
    longer, size = n % k, n // k
    cut = longer * (size + 1)
    part = F.when(F.col("__n") < cut, F.floor(F.col("__n") / (size + 1))).otherwise(longer + F.floor((F.col("__n") - cut) / max(size, 1)))
    twice = 2 if frame.definition.neighboring == SUBSTITUTE else 1
    df = numbered.withColumn("part", part.cast("long")).drop("__n")
    return frame.new_rows(df, keys=(*frame.keys, Key("part", tuple(range(k)))), n=None, stability=frame.stability * twice)


def numbering(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """df with __n, the place of each row (from 0) in the order of columns, without a sort of all rows in one task.

    Rows are dealt by ranges (a random number splits those that are equal) and written once, with their range and place in
    it; the lengths of the ranges, a number each, then give where each begins. Both readings are of the same written rows.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order_by], F.rand()).sortWithinPartitions(*order_by).withColumn("__p", F.spark_partition_id())
    ranged = written(ranged.withColumn("__r", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)), "ranged")
    lengths = sorted((r["__p"], r["n"]) for r in ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
    before, begins = 0, []
    for p, n in lengths:
        begins.append((p, before))
        before += n
    placed = ranged.join(F.broadcast(df.sparkSession.createDataFrame(begins, "__p int, __before long")), "__p")
    return placed.withColumn("__n", F.col("__before") + F.col("__r")).drop("__p", "__r", "__before")


def map_parts(frame: PrivateFrame, operator: Callable[[PrivateFrame], object]):
    """An operator on every part: as the keys ride along, it is the operator on the partitioned frame, in one job."""
    if not frame.keys:
        raise PrivacyError("map needs a partitioned frame")
    return operator(frame)


def union_rows(*frames: PrivateFrame, flatten: bool = True) -> PrivateFrame | dict:
    """Rows of all frames (flatten), or a dict of them. What an individual may move adds up. Parts of one partition become rows of what was parted."""
    first = frames[0]
    if any(f.sample != 1.0 for f in frames):
        raise PrivacyError("sampled data cannot be united")
    if any(list(f.props) != list(first.props) for f in frames):
        raise PrivacyError("frames to be united have the same columns")
    if not flatten:
        return dict(enumerate(frames))
    df = first.df.select(*first.props)
    for f in frames[1:]:
        df = df.unionByName(f.df.select(*f.props))
    props = {n: replace(p, nullable=any(f.props[n].nullable for f in frames), lower=None, upper=None, categories=None) for n, p in first.props.items()}
    known = [f.n for f in frames]
    # individuals may have rows in each of the frames, but in one part only of a partition
    return first.new_rows(df, props=props, keys=(), n=None if None in known else sum(known), stability=round(composed((f.reach, Usage(f.stability)) for f in frames).epsilon), not_empty=any(f.not_empty for f in frames), public=all(f.public for f in frames), path=common(f.reach for f in frames))


def flatten_parts(frame: PrivateFrame) -> PrivateFrame:
    """A partitioned frame without its keys: the union of its parts."""
    declared = F.lit(True)
    for k in frame.keys:
        declared = declared & F.col(k.name).isin(list(k.categories))
    return frame.new_rows(frame.df.where(declared), keys=())


def released_column_bind(*values) -> list:
    """Released values side by side."""
    return [x for v in values for x in (v if isinstance(v, (list, tuple, np.ndarray)) else [v])]

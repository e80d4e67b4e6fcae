"""Requests from blocks of texts to shards of hash keys, and the answers back.

A block sends each shard the keys that it has of it, with counts, as one row; the shard answers with a count for each key,
in the same order. Blocks and shards both grow with the input, so with very many shards a row would hold few keys. From
FAN shards on, shards are therefore put in groups of about the square root of their number: a block sends one row a group,
a router joins the rows of many blocks and deals them to the group's shards, and its answers go back the same way. Rows are
then blocks times the square root of shards (at 100 TB some 2,500 a block, of 400 keys each), and no task holds more than a
block's or a shard's keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import pack_counts, pack_keys, unpack_counts, unpack_keys

#: Shards up to which a block sends each its own row.
FAN = 4096
ROW = "block long, shard int, kind int, sizes binary, keys binary, values array<binary>, n long"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64()]


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def fan(shards: int) -> int:
    """Shards of a group; 1: there are no groups."""
    return 1 if shards <= FAN else math.isqrt(shards - 1) + 1


def cells(edges: np.ndarray, each: int) -> Iterator[tuple[int, int, int, bytes]]:
    """For keys in order of shard, of which shard s has edges[s] .. edges[s + 1]: each group (or shard) that has some, with its begin, end and the sizes of its shards."""
    shards = len(edges) - 1
    for g in range(-(-shards // each)):
        own = edges[g * each : min((g + 1) * each, shards) + 1]
        if own[0] < own[-1]:
            yield g, int(own[0]), int(own[-1]), pack_counts(np.diff(own)) if each > 1 else b""


def _joined(rows: pa.Table, by: str) -> tuple[list, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of rows in order of a column: that column, the sizes of each, all keys, and all values."""
    rows = rows.sort_by(by)
    sizes = [unpack_counts(s) for s in rows.column("sizes").to_pylist()]
    keys = np.concatenate([unpack_keys(k) if k else np.empty(0, np.uint64) for k in rows.column("keys").to_pylist()])
    values = [np.concatenate([unpack_counts(c) for c in v]) for v in zip(*rows.column("values").to_pylist())]
    return rows.column(by).to_pylist(), sizes, keys, values


def _forward(each: int):
    def work(key: tuple, rows: pa.Table) -> pa.Table:
        (group, top, kind), out = (k.as_py() for k in key), []
        blocks, sizes, keys, values = _joined(rows, "block")
        shard = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
        owner = np.repeat(np.array(blocks) - group * each, [int(s.sum()) for s in sizes])
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            own = np.bincount(owner[part], minlength=each)
            out.append((group, top * each + int(shard[part[0]]), kind, pack_counts(own), pack_keys(keys[part]), [pack_counts(v[part]) for v in values], 0))
        return table(out)

    return work


def _back(each: int):
    def work(key: tuple, rows: pa.Table) -> pa.Table:
        (group, top, kind), out = (k.as_py() for k in key), []
        _, sizes, _, values = _joined(rows, "shard")
        owner = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
        order = np.argsort(owner, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            out.append((group * each + int(owner[part[0]]), top, kind, b"", b"", [pack_counts(v[part]) for v in values], 0))
        return table(out)

    return work


def ask(asked: DataFrame, shards: int, answer: Callable[[pa.Table], pa.Table], save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The answers to rows of requests (see ROW and cells), a row for each; and the shards' own rows, whose n is what a shard says of itself.

    answer: of all rows of a shard and kind, the rows with new values. save: writes the shards' answers, which are read twice.
    """
    each = fan(shards)
    if each > 1:
        group = (F.col("block") - F.pmod("block", F.lit(each))) / each
        asked = asked.groupBy(group.cast("long").alias("__group"), "shard", "kind").applyInArrow(_forward(each), ROW)
    answers = save(asked.groupBy("shard", "kind").applyInArrow(answer, ROW))
    if each == 1:
        return answers, answers
    top = F.floor(F.col("shard") / each)
    return answers.groupBy(F.col("block").alias("__group"), top.alias("__top"), "kind").applyInArrow(_back(each), ROW), answers

"""Private releases of a stream: one planned release a micro-batch, charged to a ledger; the stream stops at its limit."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hushframe.plans import planner, shared
from hushframe.plans.frame import Noisy, PrivateFrame
from hushframe.privacy import Definition, Ledger, Usage
from hushframe.sources import readers

#: Batches whose values are kept: Spark runs again only the last one that it hasn't committed.
KEPT = 3


def _encoded(x):
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    if isinstance(x, dict):
        return {"keys": [[list(k) if isinstance(k, tuple) else [k], _encoded(v)] for k, v in x.items()]}
    return {"list": [_encoded(v) for v in x]} if isinstance(x, (list, tuple)) else x.item() if isinstance(x, np.generic) else x


def _decoded(x):
    if not isinstance(x, dict):
        return x
    if "array" in x:
        return np.array(x["array"])
    return {tuple(k): _decoded(v) for k, v in x["keys"]} if "keys" in x else [_decoded(v) for v in x["list"]]


class Releases:
    """What a stream has released, and what that cost so far, in a folder beside its checkpoint: a small file a batch, of which the last few stay."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in shared.names(self.spark, self.folder) if n.isdigit())

    def read(self, number: int) -> tuple[list, Usage] | None:
        """Values of a batch and the cost up to it; none if it isn't there in full."""
        if number not in self.numbers():
            return None
        row = self.spark.read.schema("said string").parquet(f"{self.folder}/{number}").first()
        if row is None:
            return None
        said = json.loads(row["said"])
        return _decoded(said["values"]), Usage(*said["spent"])

    def write(self, number: int, values: list, spent: Usage) -> None:
        said = json.dumps({"values": _encoded(values), "spent": [spent.epsilon, spent.delta]})
        self.spark.createDataFrame([(said,)], "said string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        for old in self.numbers()[:-KEPT]:
            shared.delete(self.spark, f"{self.folder}/{old}")

    def spent(self) -> Usage:
        for n in reversed(self.numbers()):
            if found := self.read(n):
                return found[1]
        return Usage(0.0)


def release_stream(stream: DataFrame, plan: Callable[[PrivateFrame], list[Noisy]], sink: Callable[[int, list], None], ledger: Ledger, definition: Definition | None = None, rows_per_individual: int = 1, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Runs plan on every micro-batch and hands its values to sink with the batch's number.

    An individual may be in any batch, so budgets of batches add up. With a checkpoint, values and cost are written beside
    it before the sink sees them: a batch that Spark runs again, in this process or the next, hands on the same values and
    is not charged again, and a stream that begins again charges its ledger with what it has spent before. Without a
    checkpoint Spark begins a new stream each time, and only the last values are kept, in memory.
    """
    spark = stream.sparkSession
    kept = Releases(spark, f"{checkpoint.rstrip('/')}-releases") if checkpoint else None
    name = f"stream {checkpoint}" if checkpoint else "stream"
    last: dict[int, list] = {}
    if kept:
        before, own = kept.spent(), ledger.of(name)
        missing = Usage(max(before.epsilon - own.epsilon, 0.0), max(before.delta - own.delta, 0.0))
        if missing.epsilon or missing.delta:
            ledger.spend(name, missing, -1)

    def batch(df: DataFrame, number: int) -> None:
        found = kept.read(number) if kept else None
        if found is not None:
            sink(number, found[0])
            return
        if number not in last:
            planned = plan(readers.from_dataframe(df, definition, rows_per_individual))
            values = planner.release(planned, ledger, number, name)
            if kept:
                kept.write(number, values, ledger.of(name))
            last.clear()
            last[number] = values
        sink(number, last[number])

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

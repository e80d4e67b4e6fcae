"""What the operators share: the shared work folder, block sizes, word cutting and hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.plans import shared

#: Bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters for the same on the JVM, with translate().
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (of a few numbers each) up to which a counted table is broadcast.
BROADCAST_ROWS = 500_000
#: Rows of one key over which a join by a shuffle treats it by itself.
HOT_ROWS = 100_000
#: Sampled units of bytes of a shard, by which borders of shards are found; shards whose sample is sorted in one task.
SAMPLED, RANGED = 400, 1000
#: Entries after which a worker's table of words is emptied; only memory depends on it.
WORD_TABLE = 200_000


class Work:
    """A folder of written tables under the application's shared one, which goes when the driver ends: each table cuts the lineage and outlives the executor that made it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared.own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._hush_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for t in tables:
            shared.delete(self.spark, t._hush_path)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished steps, which it finds by garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small table has fewer partitions than the cluster has cores; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def size_of(df: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows and bytes of a string column, for numbers of blocks; one aggregate that reads one column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def parts(total: int, each: int) -> int:
    return max(1, -(-int(total) // int(each)))


def byte_shards(work: Work, df: DataFrame, place: Column, size: Column, n_shards: int) -> DataFrame:
    """df with shard: ranges of place (a number, never null) that hold about equal sums of size, from 0 in ascending order.

    Borders come from a written sample in which a row is as often as its size asks for, sorted across tasks and numbered by
    counts of its partitions; each SAMPLED-th place is one. They are eight bytes a shard, so they are handed to tasks as one
    array (50 MB for the shards of 100 TB), not as part of the plan. Rows of one place lie in one shard, however many they are.
    """
    if n_shards < 2:
        return df.withColumn("shard", F.lit(0))
    units = df.select(place.cast("long").alias("place"), size.cast("long").alias("size"), F.xxhash64(place, F.monotonically_increasing_id()).alias("row"))
    total = units.agg(F.sum("size")).first()[0] or 0
    unit = max(1, total // (SAMPLED * n_shards))
    times = F.floor(F.col("size") / unit) + (F.pmod("row", F.lit(unit)) < F.col("size") % unit).cast("long")  # the rest by chance
    sample = units.select("place", times.alias("n")).where("n > 0").select("place", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("place")
    dealt = work.table(sample.repartitionByRange(parts(n_shards, RANGED), "place").withColumn("range", F.spark_partition_id()), "places")
    counts = sorted(dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for RANGED shards
    earlier, before = [], 0
    for r, n in counts:
        earlier.append((r, before))
        before += n
    base = F.broadcast(work.spark.createDataFrame(earlier, "range int, before long"))
    each = max(1, before // n_shards)
    number = F.row_number().over(Window.partitionBy("range").orderBy("place")) + F.col("before")
    picked = dealt.join(base, "range").select("place", number.alias("number")).where((F.col("number") % each == 0) & (F.col("number") < each * n_shards)).select("place")
    borders = work.spark.sparkContext.broadcast(np.sort(picked.toArrow().column(0).to_numpy()))
    work.drop(dealt)

    @F.arrow_udf("int")
    def shard(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(borders.value, places.to_numpy(zero_copy_only=False)), pa.int32())

    return df.withColumn("shard", shard(place.cast("long")))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows, as counted; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def own_columns(docs: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def lookup(left: DataFrame, right: DataFrame, on: str, most: int | None = None) -> DataFrame:
    """left with the columns of right, a table with one row a value of on (or none). most: a bound on right's rows, if one is known.

    A small right side is broadcast, as counted. Beyond that, values that over HOT_ROWS rows of left have are looked up in
    a broadcast of just those (there are few by their definition); other rows are joined by a shuffle, in which a row without
    a match to find (on is null, or found already) is dealt by its own hash. So no value is a hot task.
    """
    if most is not None and most <= BROADCAST_ROWS or right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, "left")
    values, names = [c for c in right.columns if c != on], left.columns
    often = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select(on)
    hot = right.join(F.broadcast(often), on, "left_semi").select(F.col(on).alias("__hot"), F.struct(*values).alias("__found"))
    own = left.withColumn("__row", F.struct(*names)).select("__row", F.col(on).alias("__on")).join(F.broadcast(hot), F.col("__on") == F.col("__hot"), "left")
    asked = F.when(F.col("__found").isNull(), F.col("__on"))
    own = own.withColumn("__asked", asked).withColumn("__salt", F.when(F.col("__asked").isNull(), F.xxhash64("__row") % 1024).otherwise(0))
    rest = right.select(F.col(on).alias("__asked"), F.lit(0).cast("long").alias("__salt"), F.struct(*values).alias("__cold"))
    out = own.join(rest, ["__asked", "__salt"], "left").withColumn("__value", F.coalesce("__found", "__cold"))
    return out.select(F.col(f"__row.{on}").alias(on), *[F.col(f"__row.{c}").alias(c) for c in names if c != on], *[F.col(f"__value.{c}").alias(c) for c in values])


def once(work: Work, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of rows that have the same key and text. Only rows whose key is repeated are shuffled."""
    again = work.table(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key), "again")
    if again.isEmpty():
        return docs
    single, many = (docs.join(small(again), key, how).select(*own_columns(docs)) for how in ("left_anti", "left_semi"))
    return work.table(single.unionByName(many.dropDuplicates([key, text])), "once")


def lowered(col: str | Column) -> Column:
    return F.translate(F.col(col) if isinstance(col, str) else col, UPPER_LETTERS, LOWER_LETTERS)


def crc32_mod(col: str, mod: int) -> Column:
    """crc32 of the decimal text of an integer column, modulo mod."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


class WordTable(dict):
    """Word (bytes) -> 64-bit hash; kept while a worker lives, emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = WordTable()


def give_back(words: bool = False) -> None:
    """Returns what a Python worker has freed to the system (and empties its table of words), as workers stay between stages."""
    if words:
        _words.clear()
    gc.collect()
    trim()


def trim() -> None:
    """The same between blocks of work, without a search for cycles: pools keep several blocks' freed memory otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text whose A-Z are lower-cased. bytes.split() cuts at just these six bytes."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.translate(LOWER).split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts, most of which are small: a byte each, and those of 255 and more by themselves."""
    low, big = zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes(), 1), x[x >= 255].astype("<i8").tobytes()
    return len(low).to_bytes(4, "little") + low + big


def unpack_counts(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    out = np.frombuffer(zlib.decompress(b[4 : 4 + n]), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(b[4 + n :], "<i8")
    return out


def pack_keys(x: np.ndarray) -> bytes:
    """Keys in 32-bit gaps if they are sorted and lie close, in five bytes each if these hold them, else whole."""
    if len(x) and (x[1:] >= x[:-1]).all():
        gaps = np.diff(x, prepend=np.uint64(0))
        if gaps.max() < 1 << 32:
            return b"g" + gaps.astype("<u4").tobytes()
    if len(x) and x.max() < 1 << 40:
        return b"f" + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return b"w" + x.astype("<u8").tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    if b[:1] == b"g":
        return np.cumsum(np.frombuffer(b, "<u4", offset=1), dtype=np.uint64)
    if b[:1] == b"f":
        out = np.zeros((len(b) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, 5)
        return out.view("<u8")[:, 0]
    return np.frombuffer(b, "<u8", offset=1)

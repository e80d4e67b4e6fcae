"""Language-model scores by deleted interpolation of trigrams.

P(w | u v) mixes the maximum-likelihood estimates c(uvw)/c(uv), c(vw)/c(v), c(w)/N and 1/(V+1). The weights depend on a
bucket of the context's frequencies, c(uv) and c(v) by powers of two, and are learned by expectation-maximisation on a
deleted part of the training texts, whose own counts are taken out of the estimates they are weighed on.

Counts are not looked up token by token. Texts are dealt into blocks; a block sends each shard of the n-gram space the
distinct n-grams it has, with its own counts; a shard adds up the counts of all blocks and answers each block for its
n-grams, in the same order (see routing). A block then scores its texts with its answers. A frequent n-gram is one entry of
a block, however often it occurs, so no shard is hot, and counts cover all training texts.

Words are 64-bit hashes. A bigram or trigram is a 40-bit hash within its shard; shards grow in number with the input, not
in size, so at any size about one n-gram in 250,000 shares its count with another. Unigrams, N, V and the base score
are not affected.

Defined results: a null or empty text is one token, its end. With no training text N and V are 0 and every estimate is
1/(V+1). Repeated rows count and are scored each by itself. A text of over PIECE_BYTES is worked on in pieces, each with the
two words before it, and its pieces' sums are added up: no block grows with it. Columns beside those named are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import routing
from hushframe.llm.common import Work, crc32_mod, mix, pack_counts, pack_keys, parts, size_of, unpack_counts, unpack_keys, word_hashes

#: Bytes of text of a block and of a shard's share, about.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
#: Bytes of a text over which it is worked on in pieces; bytes before a piece in which its lead is looked for first.
PIECE_BYTES, NEAR = 4 << 20, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Rounds of expectation-maximisation; steps a power of two by which held-out events are counted together; weight of the even mixture, in events.
ROUNDS, STEPS, PRIOR = 40, 4, 1.0
LOW_BITS = np.uint64(40)
LOW_MASK = np.uint64((1 << 40) - 1)
_END, _START, _FIRST = np.uint64(0x656E64), np.uint64(0x5354415254), np.uint64(0x4649525354)
_B, _T = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Buckets of one context frequency.
LEVELS = 20


class Block:
    """The n-grams of some texts: per token, places among the distinct unigrams, and bigrams and trigrams.

    A piece of a long text begins with its lead, the last (two, if there are) words of the piece before: they are tokens
    that give context, but aren't the piece's own. Only a text's last piece has its end.
    """

    def __init__(self, texts: list[bytes | None], shards: int, leads: list[int] | None = None, last: list[bool] | None = None):
        words = [word_hashes(t) for t in texts]
        leads, last = leads or [0] * len(texts), last or [True] * len(texts)
        sizes = np.array([len(w) + e for w, e in zip(words, last)], np.int64)
        self.lengths = sizes - np.array(leads, np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        w = np.concatenate([x for t, e in zip(words, last) for x in (t, [_END] if e else [])]) if texts else np.empty(0, np.uint64)
        w = w.astype(np.uint64)
        del words
        self.own = np.ones(len(w), bool)
        for at, n in zip((np.cumsum(sizes) - sizes).tolist(), leads):
            self.own[at : at + n] = False
        self.first = np.r_[True, self.doc[1:] != self.doc[:-1]] if len(w) else np.empty(0, bool)
        before = np.r_[_START, w[:-1]].astype(np.uint64)[: len(w)]
        before[self.first] = _START
        b = mix(mix(before) * _B + w)
        before = np.r_[_FIRST, b[:-1]].astype(np.uint64)[: len(w)]
        before[self.first] = _FIRST
        t = mix(mix(before) * _T + w)
        del before
        n = np.uint64(shards)
        # unigrams in order of shard and hash; the others by shard and low bits
        self.uni, inverse = np.unique(w, return_inverse=True)
        self.uni_shard = (mix(self.uni) >> LOW_BITS) % n
        order = np.lexsort((self.uni, self.uni_shard))
        self.uni, self.uni_shard = self.uni[order], self.uni_shard[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at_1 = place[inverse].astype(np.int32)
        both = np.concatenate([b, t])
        del b, t, inverse, place
        both = ((both >> LOW_BITS) % n) << LOW_BITS | (both & LOW_MASK)
        self.many, inverse = np.unique(both, return_inverse=True)
        inverse = inverse.astype(np.int32)
        self.at_2, self.at_3 = inverse[: len(w)], inverse[len(w) :]

    @classmethod
    def of(cls, docs: pa.Table, shards: int) -> Block:
        return cls(docs.column("text").to_pylist(), shards, docs.column("lead").to_pylist(), docs.column("last").to_pylist())

    def bounds(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.arange(shards + 1, dtype=np.uint64)
        return np.searchsorted(self.uni_shard, edges), np.searchsorted(self.many >> LOW_BITS, edges)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts (key, text) in pieces of about PIECE_BYTES, cut at white space: key, row (of its own for each row), text (the lead and the piece), lead, last."""
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            row, start = uuid.uuid4().hex, 0
            while start < len(text):
                end = start + PIECE_BYTES
                gap = _SPACE.search(text, end) if end < len(text) else None
                end = gap.start() if gap else len(text)
                near = text[max(0, start - NEAR) : start]
                lead = near.split() if start <= NEAR or len(near.split()) > 2 else text[:start].split()
                lead = lead[-2:]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([row]), pa.array([b" ".join([*lead, text[start:end]])], pa.binary()), pa.array([len(lead)], pa.int32()), pa.array([end == len(text)])], ["doc_id", "row", "text", "lead", "last"])
                start = end


def _requests(shards: int):
    each = routing.fan(shards)

    def work(docs: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        x = Block.of(docs, shards)
        flags = [x.own & np.array(docs.column(c).to_pylist(), bool)[x.doc] for c in ("train", "deleted")]
        begins = x.first & x.own
        one, many = x.bounds(shards)
        rows = []
        for kind, edges, keys, places in ((1, one, x.uni, [x.at_1]), (2, many, x.many & LOW_MASK, [x.at_2, x.at_3])):
            counts = [sum(np.bincount(p[flag], minlength=len(keys)) for p in places) for flag in flags]
            rows += [(block, s, kind, sizes, pack_keys(keys[i:j]), [pack_counts(c[i:j]) for c in counts], 0) for s, i, j, sizes in routing.cells(edges, each)]
        # how many tokens and texts there are goes to any shard, as two counts that nobody asks back
        totals = [np.array([flag.sum(), (begins & flag).sum()]) for flag in flags]
        rows.append((block, int(mix(np.array([block], np.int64).view(np.uint64))[0] % np.uint64(-(-shards // each))), 0, pack_counts(np.array([2])) if each > 1 else b"", pack_keys(np.arange(2, dtype=np.uint64)), [pack_counts(t) for t in totals], 0))
        return routing.table(rows)

    return work


def _answers(rows: pa.Table) -> pa.Table:
    """A shard's answers: of each row's n-grams, the counts over all blocks; n of the first row: distinct training keys."""
    keys = [unpack_keys(k) for k in rows.column("keys").to_pylist()]
    code, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    train, deleted = (np.bincount(inverse, np.concatenate([unpack_counts(c) for c in v]), len(code)).astype(np.int64) for v in zip(*rows.column("values").to_pylist()))
    parts = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
    said = [[pack_counts(train[p]), pack_counts(deleted[p])] for p in parts]
    n = [int((train > 0).sum()), *[0] * (len(keys) - 1)]
    empty = pa.array([b""] * len(keys), pa.binary())
    return pa.Table.from_arrays([rows.column("block"), rows.column("shard"), rows.column("kind"), rows.column("sizes"), empty, pa.array(said, pa.list_(pa.binary())), pa.array(n, pa.int64())], names=rows.column_names)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and texts that a shard has counted: of training texts, and of those among them that weights are learned on."""
    for b in batches:
        rows = [[int(x) for v in values for x in unpack_counts(v)[:2]] for values in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["n", "texts", "n_out", "texts_out"])


def _counts(answers: pa.Table, take_deleted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's unigrams, and of its bigrams and trigrams, in the block's order."""
    rows = sorted(zip(*[answers.column(c).to_pylist() for c in ("kind", "shard", "values")]))
    out = {1: [np.empty(0, np.int64)], 2: [np.empty(0, np.int64)]}
    for kind, _, (train, deleted) in rows:
        out[kind].append(unpack_counts(train) - unpack_counts(deleted) if take_deleted else unpack_counts(train))
    return np.concatenate(out[1]), np.concatenate(out[2])


class Estimates:
    """Per token: the three maximum-likelihood estimates, its context's bucket, and the unigram count."""

    def __init__(self, x: Block, one: np.ndarray, many: np.ndarray, n: int, texts: int):
        self.c1, c2, c3 = one[x.at_1], many[x.at_2], many[x.at_3]
        h2 = np.r_[texts, self.c1[:-1]][: len(c2)]
        h3 = np.r_[texts, c2[:-1]][: len(c2)]
        h2[x.first], h3[x.first] = texts, texts
        self.p = np.stack([_ratio(c3, h3), _ratio(c2, h2), _ratio(self.c1, np.full(len(c2), n))])
        self.bucket = _level(h3) * LEVELS + _level(h2)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _level(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(x > 0, 1 + np.floor(np.log2(np.maximum(x, 1))), 0), LEVELS - 1).astype(np.int64)


def _events(shards: int, n: int, texts: int):
    """Held-out events of a block, counted by bucket and rounded estimates."""

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", "q3", "q2", "q1", "n"]
        if not docs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        x = Block.of(docs, shards)
        e = Estimates(x, *_counts(answers, True), n, texts)
        with np.errstate(divide="ignore"):
            q = np.where(e.p > 0, np.rint(np.log2(e.p) * STEPS), -1 << 12).astype(np.int64)
        cells, count = np.unique(np.stack([e.bucket, *q])[:, x.own], axis=1, return_counts=True)
        return pa.table({c: pa.array(v) for c, v in zip(names, [*cells, count])})

    return work


def _maximise(floor: float):
    """Weights of a bucket from its counted events."""

    def work(table: pa.Table) -> pa.Table:
        q = np.stack([table.column(c).to_numpy() for c in ("q3", "q2", "q1")]).astype(float)
        p = np.vstack([np.where(q > -1000, np.exp2(q / STEPS), 0.0), np.full(q.shape[1], floor)])
        n = table.column("n").to_numpy().astype(float)
        w = np.full(4, 0.25)
        for _ in range(ROUNDS):
            share = w[:, None] * p
            w = (share / share.sum(axis=0) * n).sum(axis=1) + PRIOR / 4
            w /= w.sum()
        return pa.table({"bucket": table.column("bucket")[:1], **{f"w{k}": [w[3 - k]] for k in (3, 2, 1, 0)}})

    return work


_SCORES = "doc_id long, row string, n_tokens long, n_known long, base_score double, score double"


def _score(shards: int, n: int, v: int, texts: int, weights: dict[int, list[float]]):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]]) for c in _SCORES.split(", ")})
        x = Block.of(docs, shards)
        e = Estimates(x, *_counts(answers, False), n, texts)
        table = np.full((LEVELS * LEVELS, 4), 0.25)
        for bucket, w in weights.items():
            table[bucket] = w
        w = table[e.bucket]
        p = (w[:, :3].T * e.p).sum(axis=0) + w[:, 3] / (v + 1)
        sums = lambda y: np.bincount(x.doc[x.own], y[x.own], len(x.lengths))
        base = np.log10((e.c1 + 1) / (n + v + 1))
        return pa.table({"doc_id": docs.column("doc_id"), "row": docs.column("row"), "n_tokens": x.lengths, "n_known": sums(e.c1 > 0).astype(np.int64), "base_score": sums(base), "score": sums(np.log10(p))})

    return work


def score(work: Work, docs: DataFrame, train: F.Column, deleted: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row; train and deleted are made of the key alone; deleted: the part of train that weights are learned on."""
    _, size = size_of(docs, text)
    blocks, shards = parts(size, BLOCK_BYTES), parts(size, SHARD_BYTES)
    own = parts(blocks, 7)  # blocks of deleted texts by themselves: only they are read to learn the weights
    body = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > PIECE_BYTES, F.lit(False))
    pieces = work.table(body.where(is_long).mapInArrow(_split, "doc_id long, row string, text binary, lead int, last boolean"), "pieces").withColumnRenamed("doc_id", key)
    any_long = not pieces.isEmpty()
    whole = body.withColumns({"row": F.lit(None).cast("string"), "lead": F.lit(0), "last": F.lit(True)}).select(key, "row", "text", "lead", "last")
    if any_long:
        whole = whole.where(~is_long).unionByName(pieces)
    spread = F.xxhash64(F.col(key), F.col("row"), F.when(F.col("row").isNotNull(), F.xxhash64("text")))
    dealt = whole.select(
        F.col(key).alias("doc_id"), "row", "text", "lead", "last", train.alias("train"), (train & deleted).alias("deleted"),
        F.when(train & deleted, F.lit(-1) - F.pmod(spread, F.lit(own))).otherwise(F.pmod(spread, F.lit(blocks))).alias("block"),
    )
    asked = dealt.groupBy("block").applyInArrow(_requests(shards), routing.ROW)
    answers, of_shards = routing.ask(asked, shards, _answers, lambda df: work.table(df, "answers"))
    sums = ("n", "texts", "n_out", "texts_out")
    each = of_shards.where("kind = 0").groupBy("shard").agg(F.first("values").alias("values")).select("values").mapInArrow(_totals, ", ".join(f"{c} long" for c in sums))
    n, texts, n_out, texts_out = map(int, each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first())
    answers = answers.where("kind > 0")
    v = of_shards.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    work.release()
    held = dealt.where("block < 0").groupBy("block").cogroup(answers.where("block < 0").groupBy("block")).applyInArrow(_events(shards, n - n_out, texts - texts_out), "bucket long, q3 long, q2 long, q1 long, n long")
    cells = held.groupBy("bucket", "q3", "q2", "q1").agg(F.sum("n").alias("n"))
    learned = cells.groupBy("bucket").applyInArrow(_maximise(1 / (v + 1)), "bucket long, w3 double, w2 double, w1 double, w0 double")
    weights = {r["bucket"]: [r["w3"], r["w2"], r["w1"], r["w0"]] for r in learned.limit(LEVELS * LEVELS).collect()}  # there are no more buckets
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shards, n, v, texts, weights), _SCORES)
    if any_long:  # the pieces of a row are added up
        out = work.table(out, "scores")
        summed = out.where("row is not null").groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        out = out.where("row is null").unionByName(summed)
    return out.drop("row").withColumn("train_tokens", F.lit(n).cast("long")).withColumnRenamed("doc_id", key)


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = crc32_mod("doc_id", 7)
    scores = score(Work(spark, "lm"), docs, fold != 2, fold == 3)
    return scores.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_deleted_interpolation": op6_deleted_interpolation}
ORACLES: dict[str, str] = {}

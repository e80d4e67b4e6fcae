"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

The index is a written table of postings (term, document, position) of the training tokens; it holds the terms that
occur in a benchmark, as no other list is ever asked for. A query is a window of 13 consecutive words of an item (or a
shorter item as a whole). Its terms are ordered by the length of their lists: candidates come from the rarest term's
list, adjusted by the term's offset, and are intersected with the second rarest's; the lists of the other terms are
then read for the documents that are left, and a phrase matches where all its words stand.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; a null or empty text has none. An
item without words has no window. A repeated row (same id, same text) is judged as if it stood alone, each time it
occurs; otherwise ids are taken to be unique. A document without an id has its number of words and no hits, as matches
are joined by ids. Windows with the same words are one query for all their items. A very long text
is one array of words before it is exploded. Over BROADCAST_ROWS terms or windows, tables are joined by shuffles, whose
skewed partitions Spark's adaptive execution splits. Columns beside those named are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.common import Work, lookup, lowered, own_columns, spread

WIDTH = 13
#: What separates words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a table is broadcast; it is counted first, and a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of all terms up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: A document is contaminated if its hit words times this are at least its words.
SHARE = 20


def tokens(text: str) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(F.col(text), F.lit(""))), NO_WORD), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows, as counted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """item, words (an array): each window of an item, once."""
    w = items.select(F.col(key).alias("item"), tokens(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), width).alias("words")).distinct()


class PositionalIndex:
    """Postings of the tokens of documents that are among some terms."""

    def __init__(self, work: Work, docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text"):
        self.work = work
        n, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        n = n if size <= BROADCAST_BYTES else BROADCAST_ROWS + 1
        exploded = docs.select(F.col(key).alias("doc"), F.posexplode(tokens(text)).alias("pos", "term"))
        # beyond a broadcast, terms that occur very often are looked up by themselves
        found = exploded.join(F.broadcast(terms), "term") if n <= BROADCAST_ROWS else lookup(exploded, terms, "term").where("tid is not null")
        self.postings = work.table(found.select("tid", "doc", "pos"), "postings")
        self.lengths = work.table(terms.join(self.postings.groupBy("tid").agg(F.count(F.lit(1)).alias("n")), "tid", "left").select("term", "tid", F.coalesce("n", F.lit(0)).alias("n")), "lengths")
        self.n_terms = n

    def lists(self, wanted: DataFrame) -> DataFrame:
        """Postings of the terms (column tid) of a table."""
        ids = wanted.select("tid").distinct()
        return self.postings.join(small(ids, self.n_terms), "tid", "left_semi")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """(doc, start, query, size) of all exact matches of queries (query, words)."""
        place = Window.partitionBy("query").orderBy("n", "at")
        parts = self.work.table(
            queries.select("query", F.posexplode("words").alias("at", "term"), F.size("words").alias("size")).join(small(self.lengths, self.n_terms), "term")
            .select("query", "at", "tid", "size", "n", F.row_number().over(place).alias("rank")), "parts",
        )
        n_queries = queries.count()
        first, second = (parts.where(F.col("rank") == r) for r in (1, 2))
        found = self.lists(first).join(small(first, n_queries), "tid").select("doc", (F.col("pos") - F.col("at")).alias("start"), "query", "size").where(F.col("start") >= 0)
        # the second rarest term's list; a query of one word is done
        asked = found.join(small(second.select("query", "at", "tid"), n_queries), "query", "left").withColumn("pos", F.col("start") + F.col("at"))
        single = asked.where(F.col("tid").isNull()).select("doc", "start", "query", "size")
        both = asked.where(F.col("tid").isNotNull()).join(self.lists(second), ["doc", "pos", "tid"], "left_semi").select("doc", "start", "query", "size")
        found = self.work.table(both.unionByName(single).distinct(), "candidates")  # repeated rows have postings twice
        # the other terms, in the documents that are left
        left = found.select("doc").distinct()
        here = self.postings.join(small(left, left.count()), "doc", "left_semi").select("doc", "pos", "tid")
        rest = parts.where(F.col("rank") > 2)
        asked = found.join(small(rest.select("query", "at", "tid"), n_queries * WIDTH), "query").select("doc", "start", "query", "size", (F.col("start") + F.col("at")).alias("pos"), "tid")
        whole = asked.join(here, ["doc", "pos", "tid"], "left_semi").groupBy("doc", "start", "query", "size").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.col("size") - 2).drop("k")
        return whole.unionByName(found.where(F.col("size") <= 2))

    def near(self, queries: DataFrame, width: int) -> DataFrame:
        """(doc, anchor, query) of proximity matches: positions of a query's rarest term with all its other terms at most width words away."""
        terms = queries.select("query", F.explode(F.array_distinct("words")).alias("term")).join(small(self.lengths, self.n_terms), "term")
        terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("n", "tid"))).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("query")))
        anchors = self.postings.join(terms.where("rank = 1"), "tid").select("doc", F.col("pos").alias("anchor"), "query", "terms")
        blocks = F.explode(F.array_distinct(F.array(*[F.floor((F.col("anchor") + d) / (width + 1)) for d in (-width, 0, width)])))
        asked = anchors.withColumn("block", blocks).join(terms.where("rank > 1").select("query", "tid"), "query")
        there = self.postings.withColumn("block", F.floor(F.col("pos") / (width + 1)))
        met = asked.join(there, ["doc", "block", "tid"]).where(F.abs(F.col("pos") - F.col("anchor")) <= width)
        many = met.groupBy("doc", "anchor", "query", "terms").agg(F.count_distinct("tid").alias("k")).where(F.col("k") == F.col("terms") - 1)
        return many.select("doc", "anchor", "query").unionByName(anchors.where("terms = 1").select("doc", "anchor", "query"))


def contamination(work: Work, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with a match: key, n_hit (words inside a match), n_items, items_sha256."""
    found = work.table(windows(items), "windows")
    queries = work.table(found.groupBy("words").agg(F.min(F.struct("item")).alias("i")).select(F.monotonically_increasing_id().alias("query"), "words"), "queries")
    terms = work.table(queries.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    index = PositionalIndex(work, docs, terms, key, text)
    matches = work.table(index.phrases(queries), "matches")
    work.drop(index.postings)
    # a document's positions inside matches: the union of [start, start + size), by the largest end so far
    before = Window.partitionBy("doc").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.groupBy("doc", "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    fresh = spans.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0))).select("doc", F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0)).alias("n"))
    hits = fresh.groupBy("doc").agg(F.sum("n").cast("long").alias("n_hit"))
    items_of = found.join(queries, "words").select("query", "item")
    hit_items = matches.select("doc", "query").distinct().join(items_of, "query").groupBy("doc").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return hits.join(hit_items, "doc").select(F.col("doc").alias(key), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))


def judge(work: Work, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256 and contaminated."""
    hits = contamination(work, docs, items, key, text)
    words = docs.select(key, F.size(tokens(text)).cast("long").alias("n_words"))
    out = words.join(hits, key, "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return judge(Work(spark, "decontaminate"), spread(docs.select("doc_id", "text")), items.select("item_id", "text"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that aren't contaminated by the benchmark."""
    bad = judge(Work(spark, "decontaminate"), docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*own_columns(docs))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, w[s:s + {WIDTH - 1}] AS g FROM i, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS x(s) WHERE len(w) > 0),
z AS (SELECT DISTINCT len(g) AS k FROM q),
p AS (SELECT doc_id, s, k, w[s:s + k - 1] AS g FROM d, z, unnest(range(1, greatest(len(w) - k + 2, 1))) AS x(s)),
m AS (SELECT doc_id, s, k, item_id FROM p JOIN q USING (g)),
h AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM m, unnest(range(0, k)) AS x(o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {"op4_decontaminate": ORACLE}

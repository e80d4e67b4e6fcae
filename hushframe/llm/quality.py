"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself: navigation (separators between its words), symbols, shouting, no end of a sentence,
words repeated within the line, and boilerplate (phrases of notices and of page furniture). Lines that fail are removed; a
text is then rejected if it lost over MAX_LOSS of its characters. Everything is computed inside the row, so nothing is
shuffled and no text is exploded. A rule is counted only in a line that a cheap pattern says may break it.

Lines that many documents share are no boilerplate by themselves: where a table still holds copies, every line of a
document that was copied often would be one.

Defined results: a null or empty text has no words, fails the base rule and is rejected; its cleaned text is empty.
Lines without a word neither fail nor count as lost, and stay in the cleaned text. Windows of five words are compared by
64-bit hashes within one text. A very long text is one row's arrays of words and windows (about 60 bytes a word). Repeated
rows are judged each by itself. Other columns are carried; one that is named like a result (see RESULT, MORE) is an error.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import own_columns, spread

#: White space but the space and the line end; what separates words in SQL.
ODD_SPACE = r"[\x09\x0B-\x0D]"
SYMBOLS, SEPARATORS = "#*$%&|<>", "|»›•·>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is held to the rules on sentences from so many words.
MIN_LINE_WORDS = 4
#: Largest shares in a good line: separators a word, symbols a character, capitals a letter; least share of distinct words.
MAX_SEPARATORS, MAX_SYMBOLS, MAX_CAPITALS, MIN_DISTINCT = 0.25, 0.05, 0.6, 0.4
#: A text that loses a larger share of its characters is rejected.
MAX_LOSS = 0.5
#: What ends a sentence, perhaps before closing quotes or brackets.
END = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
#: The end of a sentence inside a line.
INNER_END = r"[.!?…][\x20\x09-\x0D]"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "use of cookies", "privacy policy", "terms of service", "terms of use",
    "terms and conditions", "enable javascript", "lorem ipsum", "click here", "subscribe to our newsletter", "sign up for our newsletter",
    "skip to content", "powered by", "page not found", "licensed under", "permission is hereby granted", "without warranty of any kind",
)


#: A line may be shouting only if two capitals have no small letter between them, or none follows the last one.
MAY_SHOUT = rf"[{UPPER[0]}-{UPPER[-1]}][^{LOWER[0]}-{LOWER[-1]}]*([{UPPER[0]}-{UPPER[-1]}]|\z)"


PHRASES = "|".join(BOILERPLATE)


def words_of(line: Column) -> Column:
    """Words of a text whose only white space is the space."""
    return F.array_remove(F.split(line, " "), "")


def _number(text: Column, chars: str) -> Column:
    """Characters of a class in a text."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def line_fails(line: Column, words: Column, phrases: Column) -> Column:
    """Whether a line with words fails a rule. phrases: whether the line's text has any of the boilerplate phrases, so that it must be looked at."""
    n = F.size(words)
    capitals, small = _number(line, "A-Z"), _number(line, "a-z")
    return (
        ((n >= MIN_LINE_WORDS) & ~(line.rlike(END) | line.rlike(INNER_END)))
        | (line.rlike(f"[{SEPARATORS}]") & (_number(line, SEPARATORS) >= F.greatest(F.lit(2.0), MAX_SEPARATORS * n)))
        | (line.rlike(f"[{SYMBOLS}]") & (_number(line, SYMBOLS) > MAX_SYMBOLS * F.length(line)))
        | ((n >= MIN_LINE_WORDS) & line.rlike(MAY_SHOUT) & (capitals > MAX_CAPITALS * (capitals + small)))
        | (phrases & F.lower(line).rlike(PHRASES))
        | ((n >= 2 * MIN_LINE_WORDS) & (F.size(F.array_distinct(words)) < MIN_DISTINCT * n))
    )


def repeated_words(windows: Column) -> Column:
    """Words inside five-word windows that occur twice or more; windows: their hashes, in order."""

    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        n = F.size(at)
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < n, F.least(F.lit(5), F.get(at, i + 1) - p)).otherwise(5))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def starts(s: Column) -> Column:  # sorted (hash, start)
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["p"]))

    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, lambda s: let(starts(s), covered)))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines, lost_chars, clean_text and kept."""
    own = [c for c in docs.columns if c in (*RESULT, *MORE) and c != "doc_id"]
    if own:
        raise ValueError(f"columns {own} are named like results")
    # white space to spaces, a letter for a letter, so that words are cut at one character
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__t", t).withColumn("__odd", F.col("__t").rlike(ODD_SPACE))
    out = out.withColumn("__s", F.when(F.col("__odd"), F.regexp_replace("__t", ODD_SPACE, " ")).otherwise(F.col("__t")))
    out = out.withColumn("__low", F.lower("__s")).withColumn("__phrases", reduce(or_, [F.contains("__low", F.lit(p)) for p in BOILERPLATE]))
    cut = F.transform(F.split("__s", "\n"), lambda line: F.struct(line.alias("line"), words_of(line).alias("words")))
    out = out.withColumn("__cut", cut)
    judged = F.transform("__cut", lambda x: F.when(F.size(x["words"]) > 0, line_fails(x["line"], x["words"], F.col("__phrases"))).otherwise(F.lit(False)))
    out = out.withColumns({"__bad": judged, "__w": F.flatten(F.col("__cut.words"))})
    n = F.size("__w")
    starts = F.slice("__g", 1, F.greatest(n - 4, F.lit(0)))
    windows = F.when(n < 6, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(F.col("__g"), i + k) for k in range(1, 5)])))
    out = out.withColumn("__g", F.transform("__w", lambda x: F.xxhash64(x)))
    out = out.withColumn("__h", windows)
    with_words = F.filter("__cut", lambda x: F.size(x["words"]) > 0)
    out = out.withColumns({"n_words": n.cast("long"), "n_repeat_words": repeated_words(F.col("__h")).cast("long"), "__lines": with_words})
    lines = F.when(F.col("__odd"), F.filter(F.split("__t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).otherwise(F.col("__lines.line"))
    some = F.array_contains("__bad", True)
    lost = F.when(some, F.aggregate(F.zip_with("__cut", "__bad", lambda x, bad: F.when(bad, F.length(x["line"])).otherwise(0)), F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long")
    good = F.filter(F.split("__t", "\n"), lambda line, i: ~F.get(F.col("__bad"), i))
    out = out.withColumns({
        "word_chars": F.length(F.array_join("__w", "")).cast("long"), "n_symbols": F.when(F.col("__t").rlike(f"[{SYMBOLS}]"), _number(F.col("__t"), SYMBOLS)).otherwise(0).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), "n_lines": F.size("__lines").cast("long"), "lost_chars": lost,
        "n_failed_lines": F.when(some, F.size(F.filter("__bad", lambda b: b))).otherwise(0).cast("long"), "clean_text": F.when(some, F.array_join(good, "\n")).otherwise(F.col("__t")),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), "__chars": F.aggregate(F.col("__lines.line"), F.lit(0), lambda a, x: a + F.length(x)),
    })
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= MAX_LOSS * F.col("__chars")))
    return out.select(*own_columns(docs), *[c for c in (*RESULT, *MORE) if c != "doc_id"])


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost_chars", "kept")
MORE = ("clean_text",)


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judge(docs).select(*RESULT, F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


_LINE_WORDS = r"len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))"
_COUNT = "(length(l) - length(translate(l, '{}', '')))"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, w[i:i+4] AS g, i FROM w, unnest(range(1, len(w) - 3)) AS s(i) WHERE len(w) >= 5),
g AS (SELECT r, g FROM p GROUP BY r, g HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM p JOIN g USING (r, g), range(0, 5) AS o(k) GROUP BY r),
s AS (SELECT r, i, string_split(t, chr(10))[i] AS l FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS x(i)),
l AS (SELECT r, i, l, {_LINE_WORDS} AS n, {_COUNT.format(UPPER)} AS u, {_COUNT.format(LOWER)} AS s FROM s WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
j AS (SELECT *, {_COUNT.format(SEPARATORS)} >= greatest(2.0, {MAX_SEPARATORS} * n) OR {_COUNT.format(SYMBOLS)} > {MAX_SYMBOLS} * length(l)
  OR (n >= {MIN_LINE_WORDS} AND (u > {MAX_CAPITALS} * (u + s) OR NOT (regexp_matches(l, '{END.replace("'", "''")}') OR regexp_matches(l, '{INNER_END}'))))
  OR (n >= {2 * MIN_LINE_WORDS} AND len(list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) < {MIN_DISTINCT} * n)
  OR regexp_matches(lower(l), '{"|".join(BOILERPLATE)}') AS bad FROM l),
a AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_failed_lines, coalesce(sum(length(l)) FILTER (WHERE bad), 0) AS lost, sum(length(l)) AS chars FROM j GROUP BY r),
k AS (SELECT s.r, string_agg(s.l, chr(10) ORDER BY s.i) FILTER (WHERE NOT coalesce(bad, false)) AS clean FROM s LEFT JOIN j ON j.r = s.r AND j.i = s.i GROUP BY s.r),
b AS (SELECT doc_id, clean, len(w) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost, 0) AS lost, coalesce(chars, 0) AS chars
  FROM w LEFT JOIN c USING (r) LEFT JOIN a USING (r) LEFT JOIN k USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, lost::BIGINT AS lost_chars,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= {MAX_LOSS} * chars AS kept, sha256(coalesce(clean, '')) AS clean_sha256 FROM b
"""

QUERIES = {"op10_line_quality": op10_line_quality}
ORACLES = {"op10_line_quality": ORACLE}

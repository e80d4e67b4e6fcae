"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound from the vectors of its
letters, permuted (rolled) by their place and multiplied; a text's vector bundles (sums) those of all its trigrams.
A language's prototype bundles the unit vectors of its labelled texts, less the mean of all prototypes, which holds
what the languages share. The prediction is the prototype of the largest cosine.

Defined results: a null text, or one without a letter, is UND with score 0; so is every text if nothing was learned.
A null label, or a label on a text without letters, teaches nothing. Of equal cosines the smaller name wins. Repeated
rows are predicted (and counted in learning) each by itself. A very long text is worked on whole (some 50 bytes a letter).
Columns beside those named are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import Work, crc32_mod, give_back, own_columns, spread

UND = "und"
#: Length of the vectors, letters of an n-gram (fixed by the code at 3) and the fixed-point unit of learned sums.
DIMENSIONS, UNIT = 512, 1 << 20
#: Distinct labels that may be learned: prototypes go to every task, so their number has a bound.
MAX_LANGUAGES = 2000
#: Texts and characters that are worked on at once; trigrams bundled at once.
BATCH_TEXTS, BATCH_CHARS, SLICE = 128, 1_000_000, 8192
#: Rows that sample() draws of a larger table, about; of each language at least so many, if it has them. No query samples.
LEARN_TEXTS, LEARN_EACH = 20_000, 500
#: How sharply the score follows the difference of cosines.
SHARPNESS = 12.0
#: Letters from which a text's cosine says whether it is in a learned language at all; how far below those of learned texts it must lie.
SURE_LETTERS, FAR = 200, 0.5
#: For their exact percentile, cosines are cut to so many decimals: a table of any size has few different ones to count.
DECIMALS = 4

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    """By code point: whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same in every process."""
    if len(_vectors) > 20_000:
        _vectors.clear()
    for p in points.tolist():
        if p not in _vectors:
            _vectors[p] = np.random.default_rng(p).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return np.stack([_vectors[p] for p in points.tolist()])


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vectors of texts (float32, a row each), and how many letters each has."""
    lower = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lower])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _is_letter()[points]
    has = np.bincount(doc[letter], minlength=len(texts))
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(points) < 3:
        return out, has
    keep = letter.copy()  # of a run of other characters the first stays, as a space
    keep[1:] |= letter[:-1]
    points, doc = np.where(letter, points, np.uint32(32))[keep], doc[keep]
    seen = np.bincount(points, minlength=33) > 0
    kinds = np.flatnonzero(seen)
    k = len(kinds)
    ids = (np.cumsum(seen) - 1).astype(np.int32 if k < 1200 else np.int64)[points]
    code = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    same = doc[2:] == doc[:-2]
    code, doc = code[same], doc[2:][same]
    if k**3 <= 4_000_000:
        seen = np.bincount(code, minlength=k**3) > 0
        grams = np.flatnonzero(seen)
        gram = (np.cumsum(seen) - 1).astype(np.int32)[code]
    else:
        grams, gram = np.unique(code, return_inverse=True)
    base = _letter_vectors(kinds)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    for at in range(0, len(grams), SLICE):
        part = grams[at : at + SLICE]
        rows = slice(None) if len(grams) <= SLICE else (gram >= at) & (gram < at + SLICE)
        vectors = (first[part // (k * k)] * second[part // k % k] * base[part % k]).astype(np.float32)
        counts = np.bincount(doc[rows].astype(np.int64) * len(part) + gram[rows] - at, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ vectors
    return out, has


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of pieces of a column, whole texts each."""
    start, piece, chars = 0, [], 0
    for i, t in enumerate(column):
        piece.append(t.as_py())
        chars += len(piece[-1] or "")
        if len(piece) >= BATCH_TEXTS or chars >= BATCH_CHARS:
            yield start, piece
            start, piece, chars = i + 1, [], 0
    if piece:
        yield start, piece


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def shares(counts: dict[str, int]) -> dict[str, float]:
    """Of languages that sample() doesn't take whole, the share of rows that it draws."""
    left, cap = LEARN_TEXTS, 0
    for k, n in enumerate(sorted(counts.values())):
        cap = left // (len(counts) - k)
        if n > cap:
            break
        left -= n
    else:
        return {}
    cap = max(cap, LEARN_EACH)
    return {name: cap / n for name, n in counts.items() if n > cap}


def sample(labelled: DataFrame) -> DataFrame:
    """text and lang of LEARN_TEXTS or so of the rows with a label and a letter, drawn by a hash of the row: for a quick look at a large table. The queries learn from all rows."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in labelled.dtypes if not kind.startswith("map")])
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} labels; they are no languages")
    if part := shares({r["lang"]: r["n"] for r in counts}):
        below = labelled.sparkSession.createDataFrame([(name, int(s * (1 << 40))) for name, s in part.items()], "lang string, __below long")
        labelled = labelled.select("text", "lang", F.pmod(row, F.lit(1 << 40)).alias("__row")).join(F.broadcast(below), "lang", "left").where("__below is null or __row < __below")
    return labelled.select("text", "lang")


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from columns text and lang, of all rows with a label and a letter: names, and a unit row each. Sums are in fixed point, so their order doesn't matter."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for start, texts in _batches(b.column("text")):
                vectors, letters = bundle(texts)
                has = letters > 0
                whole = np.rint(_unit(vectors) * UNIT).astype(np.int64)
                names = np.array(langs[start : start + len(texts)])
                for name in set(names[has].tolist()):
                    total[name] = total.get(name, 0) + whole[has & (names == name)].sum(axis=0)
                if len(total) > MAX_LANGUAGES:
                    raise ValueError(f"over {MAX_LANGUAGES} labels; they are no languages")
            pa.default_memory_pool().release_unused()
        for name, v in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(v)], ["lang", "at", "v"])
        give_back()

    rows = (
        labelled.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(sums, "lang string, at long, v long")
        .groupBy("lang", "at").agg(F.sum("v").alias("v"))
    )
    found = rows.limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()  # the bound on labels, as rows
    if len(found) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"over {MAX_LANGUAGES} labels; they are no languages")
    names = sorted({r["lang"] for r in found})
    where = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), DIMENSIONS))
    for r in found:
        m[where[r["lang"]], r["at"]] = r["v"]
    if len(names) > 1:
        m = _unit(m)
        m = m - m.mean(axis=0)
    return names, _unit(m).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", more: tuple[str, str] | None = None) -> DataFrame:
    """docs with a predicted language and a score between 0 and 1 (the share of the best prototype among all); more: names of columns for the best cosine and the number of letters. Columns of these names are replaced."""
    added = [(lang_col, "string", pa.string()), (score_col, "double", pa.float64())] + ([(more[0], "double", pa.float64()), (more[1], "bigint", pa.int64())] if more else [])
    columns = [c for c in docs.columns if c not in [n for n, _, _ in added]]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c].simpleString()}" for c in columns] + [f"`{n}` {k}" for n, k, _ in added])
    own = columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list] = [[], [], [], []]
            for _, texts in _batches(b.column(own)):
                vectors, letters = bundle(texts)
                has = letters > 0 if names else np.zeros(len(texts), bool)
                cosine = _unit(vectors) @ prototypes.T if names else np.zeros((len(texts), 1))
                share = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                share = share.max(axis=1) / share.sum(axis=1)
                best = cosine.argmax(axis=1)
                found[0] += [names[i] if ok else UND for i, ok in zip(best, has)]
                found[1] += np.where(has, share, 0.0).tolist()
                found[2] += cosine.max(axis=1).tolist()
                found[3] += letters.tolist()
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, k) for v, (_, _, k) in zip(found, added)]], [*columns, *[n for n, _, _ in added]])
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(score, schema)


def least_cosine(scored: DataFrame, cosine: str = "cosine", letters: str = "letters") -> float | None:
    """Below what cosine a text of SURE_LETTERS is in no language that was learned: FAR of what 99 % of such learned texts reach; none if there is none. scored: all learned texts with their best cosine and number of letters."""
    unit = 10**DECIMALS
    sure = scored.where(F.col(letters) >= SURE_LETTERS).select(F.floor(F.col(cosine) * unit).alias("c"))
    low = sure.agg(F.expr("percentile_disc(0.01) within group (order by c)")).first()[0]
    return None if low is None else FAR * low / unit


def held_out() -> F.Column:
    return crc32_mod("doc_id", 4) == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    names, prototypes = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), names, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def reject_unknown(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose text is in some language that was learned.

    A text without a letter (or null) goes, and so does one of SURE_LETTERS or more whose best cosine is below
    least_cosine(): half of what even the least typical learned texts reach, as random letters or an alphabet that no
    learned text has. Shorter texts stay, as their cosines say little. Where no language was learned, texts with letters stay.
    All texts with a label that aren't held out are learned from, and all of these are asked for that bound: every text is
    scored once and written with its cosine, from which both the bound and the verdicts are read.
    """
    docs = spread(docs)
    names, prototypes = learn(docs.where(~held_out()))
    lang, score, cosine, letters = (unused(docs, c) for c in ("lang_pred", "score", "cosine", "letters"))
    if not names:
        return predict(docs, ["any"], np.zeros((1, DIMENSIONS), np.float32), lang_col=lang, score_col=score).where(F.col(lang) != UND).select(*own_columns(docs))
    scored = Work(spark, "language").table(predict(docs, names, prototypes, lang_col=lang, score_col=score, more=(cosine, letters)).where(F.col(lang) != UND).drop(lang, score), "scored")
    least = least_cosine(scored.where(~held_out() & F.col("lang").isNotNull()), cosine, letters)
    known = scored if least is None else scored.where((F.col(letters) < SURE_LETTERS) | (F.col(cosine) >= least))
    return known.select(*own_columns(docs))


def unused(docs: DataFrame, name: str) -> str:
    """A name like this that no column has."""
    while name in docs.columns:
        name += "_"
    return name


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}

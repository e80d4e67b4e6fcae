"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a local parser expands to the borders of what may stand there and validates it. The parsers of the four base
kinds give what a leftmost, non-overlapping search of these patterns gives, with the named checks and no retries:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)          every part at most 255
    card   [0-9]([\\x20-]?[0-9])+                          14 to 19 digits that pass Luhn's check
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                      10 to 15 digits

Further kinds need a cue: secret (token, password, key ... with = or : and a value), ssn, iban (checked modulo 97),
account (6 to 17 digits) and url (a scheme with user data before the host).

Defined results: a null text has no spans, as an empty one. Spans are code points, end exclusive, in order of start and
then of kind. Spans of different kinds may overlap. Masking joins overlapping spans and names the first one's kind; a
null text stays null. Repeated rows are handled each by itself, a very long text whole (its spans are a list in one task);
columns beside those named are carried or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import give_back, own_columns, spread

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban", "account", "url")
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api key", "access_key")
ACCOUNT_CUES = ("account", "acct", "kontonummer", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | _DIGITS
_LOCAL, _LABEL = _ALNUM | frozenset("._%+-"), _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_VALUE = _ALNUM | frozenset("_-./+=")
_URL_END = frozenset(" \t\r\n\"'<>")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in _DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, words in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("ssn", ("ssn", "social security")), ("iban", ("iban",)), ("url", SCHEMES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_anchors: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _run(text: str, i: int, chars: frozenset, most: int) -> int:
    """The end of the run of chars that starts at i."""
    while i < most and text[i] in chars:
        i += 1
    return i


def _domain(text: str, i: int, n: int) -> int:
    """The end of label(.label)+ at i, or -1."""
    e = _run(text, i, _LABEL, n)
    if e == i:
        return -1
    dots = 0
    while e + 1 < n and text[e] == "." and text[e + 1] in _LABEL:
        e, dots = _run(text, e + 1, _LABEL, n), dots + 1
    return e if dots else -1


def _octets(text: str, i: int, n: int) -> tuple[int, bool]:
    """The end of four digit runs with dots between them at i (or -1), and whether each is at most 255."""
    good = True
    for part in range(4):
        if part:
            if i >= n or text[i] != ".":
                return -1, False
            i += 1
        e = _run(text, i, _DIGITS, n)
        if e == i:
            return -1, False
        value = text[i:e].lstrip("0")
        good = good and len(value) <= 3 and int(value or "0") <= 255
        i = e
    return i, good


def _chain(text: str, i: int, n: int) -> int:
    """The end of [0-9]([ -]?[0-9])* at i."""
    e = i + 1
    while e < n:
        if text[e] in _DIGITS:
            e += 1
        elif text[e] in " -" and e + 1 < n and text[e + 1] in _DIGITS:
            e += 2
        else:
            break
    return e


def _phone(text: str, i: int, n: int) -> int:
    """The end of a phone number whose plus sign is at i, or -1."""
    if i + 1 >= n or text[i + 1] not in _DIGITS:
        return -1
    e = _run(text, i + 2, _PHONE, n)
    while e > i + 3 and text[e - 1] not in _DIGITS:
        e -= 1
    return e if e > i + 3 and text[e - 1] in _DIGITS else -1


def _skip(text: str, i: int, n: int, chars: str, most: int = 4) -> int:
    e = i
    while e < n and e - i < most and text[e] in chars:
        e += 1
    return e


def _after_cue(kind: str, text: str, i: int, n: int) -> tuple[int, int] | None:
    """The span of a value whose cue ends at i."""
    if kind == "secret":
        j = _skip(text, _skip(text, i, n, "\"'", 1), n, " ")
        if j >= n or text[j] not in "=:":
            return None
        j = _skip(text, _skip(text, j + 1, n, " "), n, "\"'", 1)
        e = _run(text, j, _VALUE, n)
        return (j, e) if e - j >= 8 else None
    j = i
    for word in ("number", "no.", "no", "nr.", "nr", "#"):
        k = _skip(text, j, n, " ")
        if text[k : k + len(word)].lower() == word:
            j = k + len(word)
            break
    j = _skip(text, j, n, " :=#")
    if kind == "ssn":
        s = text[j : j + 11]
        good = len(s) == 11 and s[3] == s[6] == "-" and all(c in _DIGITS for c in s[:3] + s[4:6] + s[7:])
        return (j, j + 11) if good and (j + 11 >= n or text[j + 11] not in _ALNUM) else None
    if kind == "iban":
        e, plain = j, ""
        while e < n and len(plain) < 34 and (text[e] in _ALNUM or text[e] == " " and e + 1 < n and text[e + 1] in _ALNUM):
            plain += text[e].strip()
            e += 1
            number = plain[4:] + plain[:4]
            if len(plain) >= 15 and (e >= n or text[e] not in _ALNUM) and plain[:2].isalpha() and plain[2:4].isdigit() and int("".join(str(int(c, 36)) for c in number)) % 97 == 1:
                return j, e
        return None
    e = _run(text, j, _DIGITS, n)
    return (j, e) if 6 <= e - j <= 17 and (e >= n or text[e] not in _ALNUM) else None


def _url(text: str, start: int, i: int, n: int, scheme: str) -> tuple[int, int] | None:
    """A URL from start whose scheme ends at i, if it names a user."""
    e = i
    while e < n and text[e] not in _URL_END:
        e += 1
    host = text[i:e].split("/", 1)[0]
    at = host.rfind("@")
    return (start, e) if at > 0 and at + 1 < len(host) else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text."""
    global _anchors
    if not text:
        return []
    _anchors = _anchors or _automaton()
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(_ASCII_LOWER)
    n, out = len(text), []
    email_end = ip_end = ip_tried = card_end = phone_end = 0
    taken: dict[str, int] = {}
    for last, (kind, size) in _anchors.iter(low):
        i = last - size + 1
        if kind == "digit":
            if i >= card_end:
                e = _chain(text, i, n)
                card_end = e
                digits = text[i:e].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", i, e))
            if i >= ip_tried:
                e, good = _octets(text, i, n)
                if e >= 0:
                    ip_end = ip_tried = e
                    if good:
                        out.append(("ip", i, e))
                else:  # no later start in this run of digits can do
                    ip_tried = _run(text, i, _DIGITS, n)
        elif kind == "at":
            j = i
            while j > email_end and text[j - 1] in _LOCAL:
                j -= 1
            e = _domain(text, i + 1, n) if j < i else -1
            if e >= 0:
                out.append(("email", j, e))
                email_end = e
        elif kind == "plus":
            if i >= phone_end and (e := _phone(text, i, n)) >= 0:
                phone_end = e
                if 10 <= sum(c in _DIGITS for c in text[i:e]) <= 15:
                    out.append(("phone", i, e))
        elif i and low[i - 1] in _ALNUM:
            continue
        elif kind == "url":
            if (span := _url(text, i, last + 1, n, low[i : last + 1])) and span[0] >= taken.get("url", 0):
                taken["url"] = span[1]
                out.append(("url", *span))
        elif (span := _after_cue(kind, text, last + 1, n)) and span[0] >= taken.get(kind, 0):
            taken[kind] = span[1]
            out.append((kind, *span))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    spans = find(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, spans (array of kind, start, end)."""
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, cell)], [key, "spans"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in a text column replaced by <KIND>."""
    columns, own = docs.columns, docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([masked(t.as_py()) for t in b.column(own)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == own else c for i, c in enumerate(b.columns)], columns)
            del b, new
        give_back()

    return docs.mapInArrow(work, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its personal data replaced; n_chars follows the text."""
    out = mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*own_columns(docs)) if "n_chars" in docs.columns else out


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}

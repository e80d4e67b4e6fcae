import re

import duckdb
import pytest

from hushframe.llm import licences
from tests.llm.conftest import ODD

LINES = [
    "Released under the MIT License.", "under the mit license under the mit license", "UNDER-THE_MIT\nLICENSE", "under the mit licenses", "mit license under the", "Licensed under the Apache License, Version 2.0 (the License);",
    "apache license version 2 cc by nc 4.0 cc by nc", "cc by", "cc by nc", "nc by cc", "Permission is hereby granted, free of charge, to any person obtaining a copy of THE software and associated documentation files",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of software and associated documentation files", "the the the under the under the mit license", "associated documentation files", "This work is licensed under the GNU General Public License, version 3.",
]


def plain(docs, templates=licences.TEMPLATES):
    out = []
    for key, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        base, labels, score = [], {}, 0.0
        for t in templates:
            for s in range(len(w)):
                if all(w[s + at : s + at + len(p)] == list(p) for at, p in t.phrases):
                    share = sum(x == y for x, y in zip(w[s:], t.words)) / len(t.words)
                    labels[t.label], score = labels.get(t.label, False) or t.base, max(score, share)
                    base += [s] * t.base
        out.append((key, len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(k for k, b in labels.items() if b)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_every_place(spark, documents, prose):
    """Odd texts, overlaps, a long text, repeated rows and a null id."""
    texts = [*ODD, *LINES, " ".join(LINES), prose(5000, 1) + LINES[9] + prose(5000, 2) + LINES[0]]
    docs = [*enumerate(texts), (None, LINES[0]), (15, texts[15]), (15, texts[15])]
    got = rows(licences.scan(documents(docs)))
    assert got == plain(docs) and {"mit", "apache-2,cc-by-nc", "gpl-3"} <= {r[6] for r in got} and any(0 < r[7] < 1 for r in got)


@pytest.mark.parametrize("common", licences.TEMPLATES[0].words)
def test_any_word_may_be_common(spark, documents, common):
    """What is looked up first depends on the corpus; what is found doesn't."""
    docs = [*enumerate(LINES[:6]), *[(100 + i, common) for i in range(9)]]
    assert rows(licences.scan(documents(docs), templates=licences.TEMPLATES[:3])) == plain(docs, licences.TEMPLATES[:3])


def test_columns_of_any_name_and_empty_tables(spark, documents):
    df = documents([LINES[0]]).withColumnsRenamed({"lang": "labels", "source": "__w", "n_chars": "score"})
    assert rows(licences.scan(df))[0][5] == "mit" and rows(licences.scan(df.limit(0))) == []


def test_sql(spark, documents):
    docs = [*enumerate([*ODD, *LINES])]
    c = duckdb.connect()
    c.register("documents", documents(docs).toPandas())
    assert sorted(c.sql(licences.oracle(licences.TEMPLATES)).fetchall(), key=repr) == rows(licences.scan(documents(docs)))

import hashlib
from collections import Counter, defaultdict

import pytest

from hushframe.llm import alignment, tokens
from hushframe.llm.common import Work
from tests.llm.conftest import ODD


def plain(docs):
    """Brute force: whole texts, dictionaries, no cuts. docs: (id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokens.default_path("piece_bpe_32k.model"))
    letter = {v: k for k, v in tokens._byte_letters().items()}
    pieces = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    counts, kept = Counter(), []
    for key, text in docs:
        ids, ends, groups = ([], []), ([], []), []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            read = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]], [pieces(i) for i in ids[1]]
            if any(b"".join(r) != (" " + text).encode() for r in read):
                ids = [], []
            else:
                for side in (0, 1):
                    at = 0
                    for r in read[side]:
                        at += len(r)
                        ends[side].append(at)
                common, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
                for e in common:
                    k, m = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
                    groups.append((ids[0][i:k], ids[1][j:m]))
                    i, j = k, m
        links = [(x, y) for left, right in groups for x in left for y in right]
        counts.update(set(links))
        kept.append((key, ids, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for key, ids, groups, links in kept:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((key, len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


MARKS = ["a  b", "x\ty", "x\t y \n z", " lead", "trail ", "\n\nword\n\n\nword ", "don't; it's: 3.14, U.S.A.", "a▁b", "▁", "\r\n;\r\n", "ééﬁÅ  　x", "x\x1cy \x1c z", "\U0001f600" * 5, "<s> </s> <0x0A> <unk>", "a.b,c!d?e:f;g#h$i%j&k*l", "aaaa" * 800, " " * 40, "  a  b"]


def test_against_whole_encodings(spark, documents, prose, monkeypatch):
    """Odd texts, repeated rows, null ids, several blocks and slices."""
    texts = [*ODD, *MARKS, prose(300, 1), prose(300, 2), prose(4000, 3), *[prose(40, i) for i in range(20)]]
    docs = [*enumerate(texts), (3, texts[3]), (None, prose(30, 9)), (None, None)]
    monkeypatch.setattr(tokens, "CHARS", 3000)
    monkeypatch.setattr(alignment, "SLICE", 2)
    assert rows(alignment.align(Work(spark, "a"), documents(docs).repartition(3))) == plain(docs)


def test_a_table_that_is_emptied(monkeypatch, prose):
    import pyarrow as pa

    paths = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("piece_bpe_32k.model")
    texts = pa.array([prose(50, i) for i in range(20)])
    want = alignment.Aligner(*paths).block(texts)
    monkeypatch.setattr(alignment, "TABLE", 60)
    own = alignment.Aligner(*paths)
    assert [own.block(texts.slice(i, 1))[1][0] for i in range(20)] == want[1] and len(own.table) < 120


def test_columns_of_any_name(spark, documents):
    df = documents(["one two", "one two three"]).withColumnsRenamed({"lang": "block", "source": "stripe", "n_chars": "key"})
    assert [r[0] for r in rows(alignment.align(Work(spark, "a"), df))] == [0, 1]


def test_empty(spark, documents):
    assert rows(alignment.align(Work(spark, "a"), documents([]))) == []


@pytest.mark.parametrize("texts", [[None], [""], ["▁"]])
def test_no_tokens(spark, documents, texts):
    assert rows(alignment.align(Work(spark, "a"), documents(texts))) == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(alignment.op11_alignment(spark, "/root/testdata/sf0.001")) == plain([(r.doc_id, r.text) for r in docs.collect()])

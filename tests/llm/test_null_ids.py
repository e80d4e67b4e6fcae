"""Documents without an id: carried, with the results that the docstrings state."""

import hashlib
import zlib

import numpy as np

import corpus_pipeline
from hushframe.llm import decontaminate, lm, minhash, packing, substrings, token_files
from tests.llm.test_pairs import brute_components, brute_removed, near_copies
from tests.llm.test_texts import direct

LARGE = 2**53 + 1


def docs_of(prose):
    """Three without an id, of which two are copies of others, among near copies, and an id that no double holds."""
    texts = near_copies(prose, 5, 1) + [prose(40, s) for s in range(3)] + [None, ""]
    return texts, [*enumerate(texts), (None, texts[0]), (None, prose(80, 77)), (None, None), (LARGE, prose(60, 78)), (LARGE + 1, prose(60, 78))]


def test_near_duplicates(spark, folder, documents, prose):
    texts, docs = docs_of(prose)
    rows = minhash.op1_minhash(spark, folder(docs)).collect()
    nameless = [r for r in rows if r["doc_id"] is None]
    assert len(nameless) == 3 and all(r["component_id"] is None and r["kept"] for r in nameless) and sorted(r["n_shingles"] for r in nameless)[0] == 0
    want = brute_components(texts)
    got = {r["doc_id"]: r for r in rows}
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in want} == want
    assert got[LARGE + 1]["component_id"] == LARGE and got[LARGE]["kept"] and not got[LARGE + 1]["kept"]
    kept = minhash.dedup_stage(spark, documents(docs), "").collect()
    assert sum(r["doc_id"] is None for r in kept) == 3


def test_repeats(spark, folder, prose, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3000)
    texts, docs = docs_of(prose)
    rows = substrings.op2_suffix_array(spark, folder(docs)).collect()
    nameless = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows if r["doc_id"] is None)
    assert nameless == sorted((len(t or ""), 0, 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs if i is None)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows if r["doc_id"] is not None}
    assert {i: got[i] for i in range(len(texts))} == brute_removed(texts)
    assert got[LARGE][1] == 0 and got[LARGE + 1][1] == got[LARGE + 1][0]


def test_packing(spark, folder, prose, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 400)
    _, docs = docs_of(prose)
    rows = packing.op3_packing(spark, folder(docs)).collect()
    want = sum(len(direct("word_bpe_49k.json", t, 1)) for _, t in docs)
    assert sum(r["length"] for r in rows) == want and {r["doc_id"] for r in rows} == {i for i, _ in docs}
    for i, t in docs:
        if i is not None:
            assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(direct("word_bpe_49k.json", t, 1))


def test_token_files(spark, folder, prose, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 600)
    _, docs = docs_of(prose)
    rows = sorted(token_files.op5_token_files(spark, folder(docs)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 3 + sorted(i for i, _ in docs if i is not None)
    ids = [direct("byte_bpe_50k.json", t, 0) for _, t in docs]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(x), zlib.crc32(x.tobytes())) for x in ids)
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()


def test_others_carry_them(spark, folder, prose):
    _, docs = docs_of(prose)
    d = folder(docs, [prose(40, 77)])
    for q in (lm.op6_deleted_interpolation, decontaminate.op4_decontaminate):
        rows = q(spark, d).collect()
        assert len(rows) == len(docs) and sum(r["doc_id"] is None for r in rows) == 3


def test_pipeline(spark, folder, prose):
    _, docs = docs_of(prose)
    rows = corpus_pipeline.run(spark, folder(docs)).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == sum(len(direct("word_bpe_49k.json", t, 1)) for i, t in docs if i is None and t)
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {0, 5, 6, 7, LARGE}

"""Near-duplicates, substrings and contamination against brute force."""

import collections
import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from hushframe.llm import common, components, decontaminate, minhash, routing, substrings
from hushframe.llm.common import LOWER, Work
from tests.llm.conftest import ODD


def shingle_set(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(prose, n, seed):
    r, base, out = random.Random(seed), prose(120, seed).split(), []
    for k in range(n):
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(len(w))] = f"x{r.random()}"
        out.append(" ".join(w))
    return out


def brute_components(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("chunk", [1024, 7])
def test_minhash(spark, folder, prose, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    texts = ODD + near_copies(prose, 40, 1) + near_copies(prose, 6, 2) + [prose(50, 99)] * 5 + [prose(40, s) for s in range(10)]
    got = {r["doc_id"]: r for r in minhash.op1_minhash(spark, folder(texts)).collect()}
    want = brute_components(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_minhash_empty(spark, folder):
    assert minhash.op1_minhash(spark, folder([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(Work(spark, "t"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["root"] for r in got.collect()} == {x: r for x, r in root.items() if r != x}


def brute_removed(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= {b[k : k + 50] for k in range(len(b) - 49)}
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("block", "hot"), [(1 << 22, 4096), (3000, 3)])
def test_substrings(spark, folder, prose, monkeypatch, block, hot):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "SHARD_BYTES", block)
    monkeypatch.setattr(substrings, "HOT", hot)
    passage, cut = prose(30, 7), prose(60, 8)
    texts = ODD + [f"{prose(20, s)} {passage} {prose(10, s + 100)}" for s in range(12)] + [cut, cut[30:200], "ab" * 300, "ab" * 200, "ba" * 30, passage[:49], passage[:50]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op2_suffix_array(spark, folder(texts)).collect()}
    assert got == brute_removed(texts)


def test_substrings_empty(spark, folder):
    assert substrings.op2_suffix_array(spark, folder([])).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, a = int(rng.integers(0, 300)), int(rng.choice([1, 2, 3, 30]))
        t = rng.integers(1, a + 1, n)
        if trial % 3 == 0 and n > 20:
            t = np.resize(t[: int(rng.integers(1, 8))], n)
        x = t.tolist()
        assert substrings.suffix_array(t, 10**9).tolist() == sorted(range(n), key=lambda i: x[i:])
        for depth in (3, 12, 50):
            order = substrings.suffix_array(t, depth).tolist()
            keys = [x[i : i + depth] for i in order]
            assert sorted(order) == list(range(n)) and keys == sorted(keys)


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER).decode())


def test_contamination(spark, folder, prose):
    items = [prose(40, 1), prose(20, 2), "tiny item", "", None, "the the the the", prose(13, 3)]
    texts = ODD + [f"{prose(30, 10)} {items[0][:150]} {prose(5, 11)}", f"{items[1]} {items[1]}", "a Tiny, ITEM!", "the the the the the the", prose(200, 12), items[6]]
    got = {r["doc_id"]: r for r in decontaminate.op4_decontaminate(spark, folder(texts, items)).collect()}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k, item in enumerate(items):
            q = words(item)
            for s in range(max(1, len(q) - 12) if q else 0):
                part = q[s : s + 13]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(str(k))
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_proximity(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(["alpha x x beta", "alpha " + "x " * 20 + "beta", "beta alpha"])
    terms = spark.createDataFrame([("alpha", 1), ("beta", 2)], "term string, tid long")
    index = decontaminate.PositionalIndex(Work(spark, "t"), docs, terms)
    q = spark.createDataFrame([(0, ["alpha", "beta"])], "query long, words array<string>")
    assert {r["doc"] for r in index.near(q, 5).select(F.col("doc")).collect()} == {0, 2}


def test_contamination_empty(spark, folder):
    assert decontaminate.op4_decontaminate(spark, folder([], ["some words of an item"])).count() == 0
    assert [r["n_hit"] for r in decontaminate.op4_decontaminate(spark, folder(["some words"], [])).collect()] == [0]


def test_contamination_of_repeated_rows(spark, folder, prose):
    item = prose(30, 1)
    got = decontaminate.op4_decontaminate(spark, folder([(7, item), (7, item), (7, item), (8, prose(40, 2)), (9, item)], [item])).collect()
    assert sorted((r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == [(7, 30, 1, True)] * 3 + [(8, 0, 0, False), (9, 30, 1, True)]


def test_dedup_of_repeated_rows(spark, documents, prose):
    docs = documents([(5, prose(60, 1))] * 3 + [(6, prose(60, 1)), (7, prose(60, 2)), (8, prose(60, 3)), (8, prose(60, 3))])
    got = minhash.dedup_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [5, 7, 8]


def test_lookup(spark, monkeypatch):
    """The join without broadcast: hot values, nulls, values without a match and clashing names."""
    rows = [(i, ["a", "b", "c", None, "z"][i % 5] if i % 3 else "a", i % 2) for i in range(200)]
    left = spark.createDataFrame(rows, "id long, k string, __n int")
    right = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("d", 4)], "k string, v int")
    want = sorted(((i, k, n, {"a": 1, "c": 3}.get(k)) for i, k, n in rows), key=repr)
    for broadcast, hot in ((500_000, 100_000), (0, 20), (0, 100_000)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = sorted(((r["id"], r["k"], r["__n"], r["v"]) for r in common.lookup(left, right, "k").collect()), key=repr)
        assert got == want


def test_minhash_without_broadcasts(spark, folder, prose, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = ODD + near_copies(prose, 30, 1) + [prose(50, 99)] * 9
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1_minhash(spark, folder(texts)).collect()}
    assert got == brute_components(texts)


def test_minhash_of_repeated_rows_and_clashing_columns(spark, documents, prose):
    docs = documents([(3, prose(60, 1)), (3, prose(60, 1)), (2, prose(60, 1)), (9, None), (9, None)]).selectExpr("doc_id", "text", "1 as root", "2 as id", "3 as name", "4 as n")
    got = minhash.near_duplicates(Work(spark, "t"), docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(2, 2, True), (3, 2, False), (3, 2, False), (9, 9, True), (9, 9, True)]


def test_minhash_of_a_long_text(spark, documents, prose):
    long = prose(400_000, 5)
    docs = documents([(1, long), (2, long + " more words at the end"), (3, prose(50, 6))])
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(Work(spark, "t"), docs).collect()) == [(1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize(("piece", "fan", "broadcast"), [(200, 4096, 500_000), (1 << 22, 3, 500_000), (90, 2, 0)])
def test_substrings_in_pieces_and_groups_of_shards(spark, folder, prose, monkeypatch, piece, fan, broadcast):
    for name, value in (("BLOCK_BYTES", 900), ("SHARD_BYTES", 700), ("HOT", 3), ("PIECE_BYTES", piece)):
        monkeypatch.setattr(substrings, name, value)
    monkeypatch.setattr(routing, "FAN", fan)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    passage = prose(30, 7)
    texts = ODD + [f"{prose(20, s)} {passage} {prose(10, s + 100)}" for s in range(12)] + ["ab" * 300, "ab" * 200, "ba" * 30, prose(80, 3), prose(80, 3), prose(80, 3)[7:]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op2_suffix_array(spark, folder(texts)).collect()}
    assert got == brute_removed(texts)


def test_substrings_of_repeated_rows(spark, folder, prose):
    a, b = prose(40, 1), prose(40, 2)
    rows = [(4, f"{a} {b}"), (4, f"{a} {b}"), (2, b), (2, b), (9, a), (9, a), (9, a)]
    got = collections.Counter((r["doc_id"], r["n_removed"], r["n_spans"]) for r in substrings.op2_suffix_array(spark, folder(rows)).collect())
    n = len(b.encode())
    assert got == {(2, 0, 0): 2, (4, n, 1): 2, (9, len(a.encode()), 1): 3}


def block_of(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "at": pa.array([0] * len(texts), pa.int64()), "text": pa.array(texts, pa.binary())})


@pytest.mark.parametrize("step", [1 << 15, 64, 1])
def test_anchors(monkeypatch, step):
    rng = np.random.default_rng(5)
    texts = [b"", b"a" * 49, b"a" * 50, b"a" * 120, rng.integers(97, 99, 400, dtype=np.uint8).tobytes(), b"", b"abc" * 60, rng.bytes(700), b"x" * 30]
    texts += [texts[4][60:200] + texts[7][100:300], b""]
    whole = b"".join(texts)
    want = substrings.anchors(np.frombuffer(whole, np.uint8))
    monkeypatch.setattr(substrings, "STEP", step)
    hashes, places = substrings.anchors(np.frombuffer(whole, np.uint8))
    assert (hashes == want[0]).all() and (places == want[1]).all()
    strings = [whole[i : i + 24] for i in range(len(whole) - 23)]
    assert len(hashes) == len(strings) and len(set(hashes.tolist())) == len(set(strings)) == len(set(zip(strings, hashes.tolist())))
    ahead = places.astype(np.int64) - np.arange(len(whole) - 49)
    assert ahead.min() >= 0 and ahead.max() <= 26
    windows = [whole[i : i + 50] for i in range(len(ahead))]
    assert len(set(windows)) == len(set(zip(windows, ahead.tolist())))  # equal windows have equal anchors
    block = substrings.Block(block_of(texts), 3)
    ends = np.cumsum([len(t) for t in texts])
    inside = [(int(np.searchsorted(ends, i, "right")), i) for i in range(len(ahead)) if np.searchsorted(ends, i, "right") == np.searchsorted(ends, i + 49, "right")]
    runs = [(d, i, a) for d, s, e, a in zip(block.doc.tolist(), block.first.tolist(), block.end.tolist(), block.anchor.tolist()) for i in range(s, e - 49)]
    assert runs == [(d, i, int(places[i])) for d, i in inside]
    assert len(set(block.anchor.tolist())) == len(block.anchor)


def test_cost_of_anchors():
    """Processor seconds of a block beside those of sorting as many numbers: 0.60 to 0.69 with arrays of the whole block, 0.19 to 0.22 in steps."""
    rng = np.random.default_rng(1)
    docs, noise = block_of([rng.integers(97, 123, 1000, dtype=np.uint8).tobytes() for _ in range(2000)]), rng.integers(0, 1 << 62, 2_000_000)

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    block, yardstick = (min(seconds(work) for _ in range(5)) for work in (lambda: substrings.Block(docs, 4), lambda: np.argsort(noise, kind="stable")))
    assert block < 0.4 * yardstick


@pytest.mark.parametrize(("chars", "table"), [(1, 0), (300, 1 << 18), (2000, 100)])
def test_substrings_sorted_in_parts(spark, folder, prose, monkeypatch, chars, table):
    monkeypatch.setattr(substrings, "SORT_CHARS", chars)
    monkeypatch.setattr(substrings, "TABLE", table)
    passage = prose(30, 7)
    texts = ODD + [f"{prose(20, s)} {passage} {prose(10, s + 100)}" for s in range(12)] + ["ab" * 300, "ab" * 200, "ba" * 30]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op2_suffix_array(spark, folder(texts)).collect()}
    assert got == brute_removed(texts)

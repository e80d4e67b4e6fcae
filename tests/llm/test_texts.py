"""Tokens, packing, scores, personal data, languages, archives and quality against brute force and round trips."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest

from hushframe.llm import decontaminate, language, lm, packing, pii, quality, routing, substrings, token_files, tokens, warc
from hushframe.llm.common import LOWER, Work, mix, pack_counts, pack_keys, unpack_counts, unpack_keys
from hushframe.llm.tokens import Encoder, default_path
from tests.llm.conftest import ODD


def direct(name, text, end):
    from tokenizers import Tokenizer

    if name not in direct.cache:
        direct.cache[name] = Tokenizer.from_file(default_path(name))
    t = direct.cache[name]
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


direct.cache = {}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("table", [1 << 20, 300])
def test_encoder(name, prose, table, monkeypatch):
    r = random.Random(1)
    parts = ["a", "Word", "ÀÉ", "ÿß", "re.", "x!", ",", "'s", " ", " ", "\n", "\t", "1", "23", "é", "́", "<|endoftext|>", "don't", "日本", "\r", "\0", "İ", "\x1c", "ok$$$", "é.%%%", "Ab!!", ".)", "*", "#1", "'ll,", ' "x."', "a\u0301!", "<s>.", "&&&"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)] + ODD + [prose(300, 5)]
    enc = Encoder(default_path(name))
    monkeypatch.setattr(tokens, "TABLE", table)
    got = [g for i in range(0, len(texts), 100) for g in enc.encode(texts[i : i + 100])]
    assert all(np.frombuffer(g, enc.dtype).tolist() == direct(name, t, 0)[:-1].tolist() for g, t in zip(got, texts))


class Counted(io.BytesIO):
    """A file that counts the bytes read of it."""

    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("words", [1 << 12, 4])
def test_wavelet(monkeypatch, words):
    monkeypatch.setattr(token_files, "BLOCK_WORDS", words)
    monkeypatch.setattr(token_files, "BLOCK_BITS", words * 64)
    x = np.random.default_rng(0).integers(0, 300, 3000)
    buffer = Counted()
    token_files.save(buffer, token_files.WaveletMatrix.build(x), np.array([7]), np.array([3000]))
    whole = buffer.tell()
    buffer.seek(0)
    w, ids, lengths, nameless = token_files.load(buffer)
    assert (w.all() == x).all() and ids.tolist() == [7] and lengths.tolist() == [3000]
    assert w.access_many(np.arange(3000)).tolist() == x.tolist()
    assert all(w.rank_many(s, np.array([0, 7, 1234, 3000])).tolist() == [(x[:i] == s).sum() for i in (0, 7, 1234, 3000)] for s in (0, 5, 299, 300))
    buffer.seek(0)
    stored = token_files.StoredMatrix(buffer)
    for m in (w, stored):
        assert all(m.access(i) == x[i] for i in range(0, 3000, 37))
        for s in (0, 5, 299, 511, 600):
            assert m.count(s) == (x == s).sum() and m.occurrences(s) == np.flatnonzero(x == s).tolist() and m.rank(s, 1234) == (x[:1234] == s).sum() and m.count(s, 100, 200) == (x[100:200] == s).sum()
        with pytest.raises(IndexError):
            m.access(3000)
        with pytest.raises(IndexError):
            m.select(5, 3000)
    assert stored.doc_ids.tolist() == [7] and stored.lengths.tolist() == [3000]
    if words == 4:  # one access reads one block of each of the nine planes
        buffer.seek(0)
        stored = token_files.StoredMatrix(buffer)
        buffer.taken = 0
        assert stored.access(1500) == x[1500] and buffer.taken < whole / 3
    one = token_files.WaveletMatrix.build(np.zeros(1, np.int64))
    assert one.all().tolist() == [0] and one.count(0) == 1 and one.select(0, 0) == 0


def test_token_files(spark, folder, prose, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    monkeypatch.setattr(token_files, "GROUP", 3)
    texts = ODD + [prose(200, s) for s in range(5)] + ["Oh! No! Why!", "!", "!" * 9 + " a"]  # the end id is also a mark
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], r["n_end_ids"]) for r in token_files.op5_token_files(spark, folder(texts)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = direct("byte_bpe_50k.json", t, 0)
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()), (ids == 0).sum())
        start += len(ids)
    assert got[len(ODD) + 5][3] == 4


def test_token_files_of_hot_keys(spark, documents, tmp_path, prose, monkeypatch):
    """Long texts side by side and many rows without an id: files stay bounded, and lie in order."""
    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    monkeypatch.setattr(token_files, "BATCH", 8)
    texts = [(None, prose(20, s)) for s in range(300)] + [(i, prose(400 if i < 20 else 10, i)) for i in range(300)]
    work = Work(spark, "test")
    manifest = work.table(token_files.write_shards(work, documents(texts).repartition(8), str(tmp_path), default_path("byte_bpe_50k.json"), 10), "manifest")
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    assert sum(r["docs"] for r in rows) == 600 and max(r["n"] for r in rows) < 2000 + 8 * 1500 and len({r["part"] for r in rows}) == len(rows) > 10
    assert len({r["part"] // token_files.FILES for r in rows if r["first"] is not None and r["first"] < 20}) >= 4  # a fifteenth of the ids, over half of their bytes
    firsts = [r["first"] for r in rows if r["first"] is not None]
    assert firsts == sorted(firsts)
    got = sorted(token_files.read_shards(manifest, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + list(range(300))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()


def test_least_pairs(monkeypatch):
    """Hashes of pairs over all documents at once are those of each by itself, wherever blocks end."""
    r = np.random.default_rng(1)
    docs = [r.integers(0, 50000, n).astype("<u2") for n in [1, 1, 2, 300, 5, 1, 40, 7, 1]]
    each = [mix(d[:-1].astype(np.uint64) << np.uint64(32) | d[1:].astype(np.uint64)).min() if len(d) > 1 else 0 for d in docs]
    for block in (1, 10, 350, 1 << 20):
        monkeypatch.setattr(packing, "PAIRS", block)
        assert packing.least_pairs(np.concatenate(docs), np.array([len(d) for d in docs])).tolist() == each


def test_packing(spark, folder, prose, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 5000)
    texts = ODD + [prose(n, n) for n in (3, 900, 2500, 40, 41, 42, 500)] + [prose(60, 5)] * 4
    rows = packing.op3_packing(spark, folder(texts)).collect()
    for i, t in enumerate(texts):
        ids, at = direct("word_bpe_49k.json", t, 1), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and total <= 2048 and total & (total - 1) == 0


def test_neighbours():
    ids = [np.array(x) for x in ([1, 2, 3, 9], [4, 5, 6], [1, 2, 3, 8], [7, 7, 7], [6, 11])]
    index = packing.Index(ids)
    assert index.neighbours(0, np.array([False, True, True, True, True])).tolist()[0] == 2
    assert index.neighbours(1, np.array([True, False, True, True, True])).tolist()[0] == 4


@pytest.mark.parametrize(("block", "first"), [(1 << 20, 32), (50, 2)])
def test_neighbours_of_a_shard(monkeypatch, block, first):
    """Every window against plain BM25 over all unused documents."""
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "FIRST", first)
    r = np.random.default_rng(4)
    ids = [np.r_[np.minimum(r.zipf(1.3, r.integers(1, 30)), 400), 0] for _ in range(700)]
    packer = packing.Packer(0, 64)
    for _ in packing.pack_shard(packer, np.arange(700), packing.Documents.of(ids)):
        pass
    packer.finish()
    order = list(dict.fromkeys(row[0] for row in packer.rows))
    assert sorted(order) == list(range(700))
    df = collections.Counter(t for x in ids for t in set(x.tolist()))
    mean = sum(map(len, ids)) / 700
    tf = [collections.Counter(x.tolist()) for x in ids]

    def score(a, b):
        return sum(max(0.0, math.log((700 - df[t] + 0.5) / (df[t] + 0.5))) * tf[b][t] * 2.2 / (tf[b][t] + 1.2 * (0.25 + 0.75 * len(ids[b]) / mean)) for t in tf[a] if t in tf[b])

    filled, seed = 0, None
    for k, i in enumerate(order):
        if seed is not None:
            scores = [score(seed, j) for j in order[k:]]
            assert scores[0] >= max(scores) - 1e-4
        if filled + len(ids[i]) > 64 or not filled:
            seed = i
        filled = (filled + len(ids[i])) % 64
        seed = seed if filled else None


def test_lean_encoding(spark, documents, prose, monkeypatch):
    """The pipeline encodes with smaller tables of pieces, to the same ids."""
    monkeypatch.setattr(packing, "LEAN_TABLE", 40)
    path, texts = tokens.default_path("word_bpe_49k.json"), [prose(30, i) + f" w{i}" for i in range(60)] + ODD
    docs = documents(texts).coalesce(1)
    lean, full = ({r["doc_id"]: bytes(r["ids"]) for r in packing.encode(docs, path, lean=x).collect()} for x in (True, False))
    assert lean == full and len(full) == len(texts)
    enc = tokens.Encoder(path)
    enc.most = packing.LEAN_TABLE
    for i in range(60):
        assert enc.encode([texts[i]])[0] == full[i][:-2] and len(enc.table) <= packing.LEAN_TABLE
    asked, encode = [], packing.encode
    monkeypatch.setattr(packing, "encode", lambda *a, lean=False: asked.append(lean) or encode(*a, lean=lean))
    packing.pack_stage(spark, docs, "")
    assert asked == [True]


def test_packing_over_a_shard(spark):
    """A neighbour that lies over 512 documents away in the shard's order is retrieved."""
    rows = [(i, i, np.array([10 + 3 * i, 11 + 3 * i, 12 + 3 * i] * 10 + [1], "<u4")) for i in range(1200)]
    rows[1100] = (1100, 1100, np.array([10, 11, 12] * 9 + [1], "<u4"))
    encoded = spark.createDataFrame([(i, near, bytearray(x.tobytes())) for i, near, x in rows], "doc_id long, near long, ids binary")
    got = packing.pack(Work(spark, "test"), encoded, 1, 64).collect()
    assert {r["sequence_id"] for r in got if r["doc_id"] == 1100} & {r["sequence_id"] for r in got if r["doc_id"] == 0}


def test_empty_tables(spark, folder):
    d = folder([])
    for q in (packing.op3_packing, token_files.op5_token_files, lm.op6_deleted_interpolation, pii.op7_pii, language.op8_language_id, warc.op9_warc, quality.op10_line_quality):
        assert q(spark, d).count() == 0


def test_packed_numbers():
    x = np.array([0, 1, 254, 255, 256, 10**12])
    assert unpack_counts(pack_counts(x)).tolist() == x.tolist()
    for k in (np.array([3, 9, 1 << 20], np.uint64), np.array([5, 1 << 39], np.uint64), np.empty(0, np.uint64)):
        assert unpack_keys(pack_keys(k)).tolist() == k.tolist()


@pytest.mark.parametrize("size", [1 << 22, 1500])
def test_scores(spark, folder, prose, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm, "SHARD_BYTES", size)
    phrases = [prose(4, s) for s in range(12)]
    texts = ODD + [" ".join(random.Random(s).choices(phrases, k=20)) for s in range(40)]
    rows = lm.op6_deleted_interpolation(spark, folder(texts)).collect()
    tokens = {i: [*(t or "").encode().translate(LOWER).split(), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(w in c for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r["score"] < 0
    out = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_match_counts(prose):
    """Estimates of one block against counts taken plainly."""
    texts = [prose(60, s).encode() for s in range(4)]
    x = lm.Block(texts, 3)
    one = np.bincount(x.at_1, minlength=len(x.uni))
    many = np.bincount(np.r_[x.at_2, x.at_3], minlength=len(x.many))
    e = lm.Estimates(x, one, many, len(x.at_1), len(texts))
    tri, bi, uni, h2 = (collections.Counter() for _ in range(4))
    events = []
    for t in texts:
        w = ["<s>", "<s>", *t.decode().lower().split(), "</s>"]
        events += [(w[i - 2], w[i - 1], w[i]) for i in range(2, len(w))]
    for u, v, w in events:
        tri[u, v, w] += 1
        bi[v, w] += 1
        h2[v] += 1
        uni[w] += 1
    h3 = collections.Counter((u, v) for u, v, _ in events)
    for k, (u, v, w) in enumerate(events):
        assert np.allclose(e.p[:, k], [tri[u, v, w] / h3[u, v], bi[v, w] / h2[v], uni[w] / len(events)])


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, t or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_personal_data():
    r = random.Random(5)
    texts = ["".join(r.choices("ab.@+0123456789 -()é", k=r.randint(0, 60))) for _ in range(20000)]
    texts += ["".join(r.choices(["1", "2", "44", ".", ".", "25", " ", "-", "a", "@", "b."], k=r.randint(0, 40))) for _ in range(10000)]
    for t in texts + ODD:
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == base_spans(t)


def test_cues_and_masks():
    text = 'token = "f6f4b6c25fd9db1a" IBAN DE89370400440532013000, ssn: 123-45-6789; account no 12345678 http://bob:pw@host.org/x mail bob@example.com'
    assert {k for k, _, _ in pii.find(text)} == {"secret", "iban", "ssn", "account", "url", "email"}
    assert pii.masked(text) == 'token = "<SECRET>" IBAN <IBAN>, ssn: <SSN>; account no <ACCOUNT> <URL> mail <EMAIL>'
    assert pii.masked(None) is None and pii.masked("broken tokens = x") == "broken tokens = x"


def test_personal_data_query(spark, folder):
    texts = ODD + ["İ mail a.b@c.de 4111 1111 1111 1111"]
    got = {r["doc_id"]: r for r in pii.op7_pii(spark, folder(texts)).collect()}
    for i, t in enumerate(texts):
        b = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(b).encode()).hexdigest() and got[i]["n_email"] == sum(k == "email" for k, _, _ in b)


def test_languages(spark, documents, prose):
    r = random.Random(2)
    other = lambda n, s: " ".join("".join(random.Random(s * 1000 + k).choices("xyzqwöü", k=5)) for k in range(n))
    texts = [(i, prose(40, i) if i % 2 else other(40, i)) for i in range(80)] + [(100, None), (101, "123 !!"), (102, "")]
    docs = documents(texts, ["aa" if i % 2 else "zz" for i, _ in texts])
    names, m = language.learn(docs.where(~language.held_out()))
    got = {x["doc_id"]: x for x in language.predict(docs, names, m).collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "zz") and 0 <= got[i]["score"] <= 1 for i in range(80))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102)) and r
    assert {x["lang_pred"] for x in language.predict(docs, [], np.zeros((0, language.DIMENSIONS))).collect()} == {"und"}


def test_archives(spark, folder):
    big = "<p>" + "long payload " * 20 + "</p>"
    pages = [("http://a/", big), ("http://b/ c", "short"), (None, None), ("http://d/", big), ("http://e/", "short"), ("http://f/", big), ("http://g/", "é" * 60)]
    got = {r["page_id"]: r for r in warc.op9_warc(spark, folder([], pages=pages)).collect()}
    for i, (_, html) in enumerate(pages):
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 0) if i in (3, 5) else ("response", None))


def test_revisits_refer_to_records(spark, tmp_path):
    """The fields of revisits name the record, address and time of a response that is in the archives."""
    big = "<p>" + "long payload " * 20 + "</p>"
    pages = spark.createDataFrame([(3, "http://c/ x", big), (1, "http://a/ b", big), (2, None, big), (4, "http://d", "z")], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.with_originals(pages), f"file://{tmp_path}").collect()
    records = [r for m in manifest for r in warc.read_warc(open(m["path"], "rb"))]
    first = next(r for r in records if r.kind == "response" and len(r.block) > 200)
    revisits = [r for r in records if r.kind == "revisit"]
    assert len(revisits) == 2 and first.headers["WARC-Target-URI"] == "http://a/%20b"
    for r in revisits:
        assert (r.headers["WARC-Refers-To"], r.headers["WARC-Refers-To-Target-URI"], r.headers["WARC-Refers-To-Date"]) == tuple(first.headers[k] for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))


def test_arc_versions():
    for version in (1, 2):
        raw = warc.arc_version_block(version, "x.arc") + warc.arc_record(version, "http://a/b c", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\n\nmore", date="19990203") + warc.arc_record(version, "dns:a", b"1.2.3.4", mime="text/dns", ip="9.9.9.9")
        info, page, dns = warc.convert(warc.read_arc(io.BytesIO(raw)))
        assert (info.kind, page.kind, dns.kind) == ("warcinfo", "response", "resource")
        assert page.headers["WARC-Date"] == "1999-02-03T00:00:00Z" and page.headers["WARC-Target-URI"] == "http://a/b%20c" and dns.headers["WARC-IP-Address"] == "9.9.9.9"
        assert page.headers["WARC-Payload-Digest"] == f"sha256:{hashlib.sha256(b'body' + bytes([10, 10]) + b'more').hexdigest()}"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(raw[:-5])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"no header\n")))


def test_quality(spark, folder, prose):
    good = "\n".join(prose(12, s) + "." for s in range(4))
    texts = ODD + [good, "Home | About | News | Contact\n" + "a | b | c | d | e | f\n" * 3, "x y z w v u " * 20, good + "\nall rights reserved 2020", "SHOUTED WORDS ARE NOT GOOD AT ALL HERE.\n" * 2, "one two three four five. " * 2]
    got = {r["doc_id"]: r for r in quality.op10_line_quality(spark, folder(texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    n = len(ODD)
    assert [got[n + k]["kept"] for k in range(5)] == [True, False, False, True, False]


def test_pipeline(spark, folder, prose):
    import corpus_pipeline

    item = prose(30, 77)
    texts = [None, "12 34", prose(100, 1), prose(100, 1), prose(100, 2) + " mail bob@example.com", item, prose(90, 3)]
    d = folder(texts, [item])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        left.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert left == [[2, 3, 4, 5, 6], [2, 4, 5, 6], [2, 4, 6], [2, 4, 6]]
    assert "<EMAIL>" in docs.where("doc_id = 4").first()["text"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == {2, 4, 6}


def test_rare_languages(spark, documents, prose, monkeypatch):
    """A language of few rows is learned whole beside one of many."""
    monkeypatch.setattr(language, "LEARN_TEXTS", 40)
    monkeypatch.setattr(language, "LEARN_EACH", 10)
    docs = documents([(i, prose(12, i)) for i in range(1200)] + [(2000, "xyz wqö üzx qyw"), (2001, "zyx öwq xüz")], ["aa"] * 1200 + ["zz"] * 2)
    names, m = language.learn(docs)
    assert names == ["aa", "zz"]
    assert language.shares({"a": 10, "b": 5}) == {} and language.shares({"a": 1000, "b": 5}) == {"a": 35 / 1000}
    assert {r["lang_pred"] for r in language.predict(docs.where("doc_id >= 2000"), names, m).collect()} == {"zz"}


def test_all_labelled_texts_are_learned(spark, documents, prose, monkeypatch):
    """Prototypes and the bound below which texts are rejected come from all labelled rows, however many there are."""
    monkeypatch.setattr(language, "LEARN_TEXTS", 10)
    monkeypatch.setattr(language, "LEARN_EACH", 5)
    r = random.Random(5)
    rare = lambda i: " ".join([prose(12, i), *["".join(r.choice("xyzqwöü") for _ in range(5)) for _ in range(60)]])
    texts = [rare(i) if i % 60 == 7 else prose(40, i) for i in range(1200)]  # 20 of them are unlike the others
    docs = documents(list(enumerate(texts)) + [(3000, rare(3000))], ["aa"] * 1200 + [None])
    names, m = language.learn(docs)
    vectors, _ = language.bundle(texts)
    total = np.rint(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * language.UNIT).astype(np.int64).sum(axis=0)
    assert names == ["aa"] and np.allclose(m[0], total / np.linalg.norm(total), atol=1e-6)
    assert {x["doc_id"] for x in language.reject_unknown(spark, docs, "").collect()} == {*range(1200), 3000}


def test_stage_without_labels(spark, documents):
    docs = documents([(0, "some words"), (1, "123"), (2, None), (3, "é")], [None] * 4).coalesce(1)
    assert {r["doc_id"] for r in language.reject_unknown(spark, docs, "").collect()} == {0, 3}


def test_archive_of_a_filedesc_page(spark, folder):
    pages = [("filedesc://x", "a page"), ("http://a/", "another"), ("filedesc://y z", "third"), ("filedesc://", None)]
    got = {r["page_id"]: r["payload_bytes"] for r in warc.op9_warc(spark, folder([], pages=pages)).collect()}
    assert got == {0: 6, 1: 7, 2: 5, 3: 0}


def test_cleaned_texts(spark, prose):
    good = prose(12, 1) + "."
    texts = [None, "", f"{good}\nHome | About | News\n\n{good}\n", good, "a\tb c\r\nall rights reserved\x0b", f"{good}\nSubscribe to our newsletter now."]
    docs = spark.createDataFrame([(i, t, "kept by") for i, t in enumerate(texts)], "doc_id long, body string, `the rest` string")
    got = {r["doc_id"]: r for r in quality.judge(docs, "body").collect()}
    assert [got[i]["clean_text"] for i in range(6)] == ["", "", f"{good}\n\n{good}\n", good, "a\tb c\r", good]
    assert got[0]["the rest"] == "kept by" and got[0]["body"] is None
    with pytest.raises(ValueError, match="named like results"):
        quality.judge(docs.withColumn("kept", docs.doc_id), "body")


@pytest.mark.parametrize(("piece", "fan"), [(60, 4096), (1 << 22, 3), (45, 2)])
def test_scores_in_pieces_and_groups_of_shards(spark, folder, prose, monkeypatch, piece, fan):
    """Long texts in pieces, and requests by way of routers, give the scores of the plain way."""
    texts = ODD + [prose(30, s) for s in range(25)] + [" " * 70, "z" * 200 + " a b", prose(30, 3)]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    d = folder(texts)
    want = {r["doc_id"]: r for r in lm.op6_deleted_interpolation(spark, d).collect()}
    monkeypatch.setattr(lm, "PIECE_BYTES", piece)
    monkeypatch.setattr(lm, "NEAR", 16)
    monkeypatch.setattr(routing, "FAN", fan)
    got = lm.op6_deleted_interpolation(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        w = want[r["doc_id"]]
        assert all(r[c] == w[c] for c in ("n_tokens", "n_known", "train_tokens", "held_out"))
        assert math.isclose(r["base_score"], w["base_score"], rel_tol=1e-9) and math.isclose(r["score"], w["score"], rel_tol=1e-6)


def test_scores_against_brute_force(spark, folder, prose):
    """The whole model taken plainly: counts, deleted counts, buckets, expectation-maximisation, mixture."""
    phrases = [prose(4, s) for s in range(12)]
    texts = ODD + [" ".join(random.Random(s).choices(phrases, k=20)) for s in range(40)]
    got = {r["doc_id"]: r["score"] for r in lm.op6_deleted_interpolation(spark, folder(texts)).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))}

    def events(i):
        w = ["<s>", "<s>", *(texts[i] or "").encode().translate(LOWER).split(), "</s>"]
        return [tuple(w[k - 2 : k + 1]) for k in range(2, len(w))]

    def counted(ids):
        c = collections.Counter()
        for i in ids:
            for u, v, w in events(i):
                c.update([(3, u, v, w), (2, v, w), (1, w), (0,)])
            c["texts"] += 1
        return c

    every, out = counted(i for i in fold if fold[i] != 2), counted(i for i in fold if fold[i] == 3)
    v_size = sum(k[0] == 1 for k in every if isinstance(k, tuple))

    def estimates(c, u, v, w):
        context3 = c["texts"] if (u, v) == ("<s>", "<s>") else c[2, u, v]
        context2 = c["texts"] if v == "<s>" else c[1, v]
        level = lambda x: 0 if x <= 0 else min(1 + int(math.floor(math.log2(x))), lm.LEVELS - 1)
        p = [c[3, u, v, w] / context3 if context3 else 0.0, c[2, v, w] / context2 if context2 else 0.0, c[1, w] / c[0,] if c[0,] else 0.0, 1 / (v_size + 1)]
        return p, (level(context3), level(context2))

    rest = collections.Counter(every)
    rest.subtract(out)
    held = collections.defaultdict(collections.Counter)
    for i in fold:
        if fold[i] == 3:
            for e in events(i):
                p, bucket = estimates(rest, *e)
                held[bucket][tuple(round(math.log2(x) * lm.STEPS) if x > 0 else None for x in p[:3])] += 1
    weights = {}
    for bucket, cells in held.items():
        w = [0.25] * 4
        for _ in range(lm.ROUNDS):
            new = [lm.PRIOR / 4] * 4
            for q, n in cells.items():
                p = [w[k] * (2 ** (q[k] / lm.STEPS) if q[k] is not None else 0.0) for k in range(3)] + [w[3] / (v_size + 1)]
                for k in range(4):
                    new[k] += n * p[k] / sum(p)
            w = [x / sum(new) for x in new]
        weights[bucket] = w
    for i in fold:
        total = 0.0
        for e in events(i):
            p, bucket = estimates(every, *e)
            total += math.log10(sum(a * b for a, b in zip(weights.get(bucket, [0.25] * 4), p)))
        assert math.isclose(got[i], total, rel_tol=1e-9), i


def test_archives_of_repeated_and_clashing_rows(spark, tmp_path, monkeypatch):
    from hushframe.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    big = "<p>" + "long payload " * 400_000 + "</p>"  # five million bytes
    rows = [(1, "http://a", big), (1, "http://a", big), (2, "http://b", big), (3, None, None), (3, None, None)]
    d = f"file://{tmp_path}"
    spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, refers_to string, __d string").write.parquet(f"{d}/pages.parquet")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.op9_warc(spark, d).collect())
    assert got == [(1, len(big), "response", 0)] * 2 + [(2, len(big), "revisit", 1)] + [(3, 0, "response", 0)] * 2


def test_languages_against_brute_force(spark, folder, prose):
    """The query against letter vectors, binding, bundling and cosines taken one trigram at a time."""
    other = lambda s: " ".join("".join(random.Random(s * 100 + k).choices("xyzqwöüna", k=5)) for k in range(12))
    texts = [prose(15, i) if i % 3 else other(i) for i in range(60)] + ODD + ["ab", "A", "Éa b", prose(15, 1), prose(15, 1)]
    langs = ["aa" if i % 3 else "zz" for i in range(60)] + [None] * (len(texts) - 60)
    spark_docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    d = folder([])
    spark_docs.write.mode("overwrite").parquet(f"{d}/documents.parquet")
    got = {r["doc_id"]: r for r in language.op8_language_id(spark, d).collect()}

    def vector(text):
        letters = re.sub(r"\x00+", " ", "".join(c if c.isalpha() else "\0" for c in (text or "").lower()))
        total = np.zeros(language.DIMENSIONS)
        for k in range(len(letters) - 2):
            bound = np.ones(language.DIMENSIONS)
            for shift, c in zip((2, 1, 0), letters[k : k + 3]):
                v = np.random.default_rng(ord(c)).integers(0, 2, language.DIMENSIONS, dtype=np.int8) * 2.0 - 1
                bound *= np.roll(v, shift)
            total += bound
        return total / max(np.linalg.norm(total), 1e-12)

    has = [any(c.isalpha() for c in t or "") for t in texts]
    learned = [i for i in range(len(texts)) if langs[i] and has[i] and zlib.crc32(str(i).encode()) % 4 != 2]
    sums = {n: sum(vector(texts[i]) for i in learned if langs[i] == n) for n in ("aa", "zz")}
    unit = {n: v / np.linalg.norm(v) for n, v in sums.items()}
    mean = sum(unit.values()) / 2
    prototypes = {n: (v - mean) / np.linalg.norm(v - mean) for n, v in unit.items()}
    for i, t in enumerate(texts):
        cosine = {n: float(vector(t) @ p) for n, p in prototypes.items()}
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not has[i]:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        top = max(cosine.values())
        if abs(cosine["aa"] - cosine["zz"]) > 1e-4:
            assert got[i]["lang_pred"] == max(cosine, key=cosine.get)
        assert math.isclose(got[i]["score"], 1 / sum(math.exp(language.SHARPNESS * (c - top)) for c in cosine.values()), rel_tol=1e-3)


def test_unknown_languages_are_rejected(spark, documents, prose):
    """Random letters and an alphabet that wasn't learned go, where they are long enough to tell; a user's columns stay as they are."""
    r = random.Random(7)
    noise, cyrillic = ("".join(r.choice(letters) for _ in range(900)) for letters in ("abcdefghijklmnopqrstuvwxyz ", "абвгдежзиклмноп "))
    docs = documents([(i, prose(60, i)) for i in range(120)] + [(200, noise), (201, cyrillic), (202, "xkzq"), (203, None), (204, "12 34")], ["en"] * 120 + [None] * 5)
    docs = docs.withColumns({"lang_pred": docs.doc_id, "cosine": docs.doc_id})
    kept = language.reject_unknown(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {x["doc_id"] for x in rows} == {*range(120), 202} and all(x["lang_pred"] == x["cosine"] == x["doc_id"] for x in rows)


def test_very_long_texts(spark, folder, prose):
    """Every query over a text of a million letters, one without any white space, and a short one."""
    item = prose(30, 3)
    long = f"{prose(60_000, 1)} {item} {prose(140_000, 2)}"
    texts = [long, "x" * 300_000, "a short one", long[:-40]]
    d = folder(texts, [item], [("http://a", long), ("http://b", long)])
    by = lambda q: {r[0]: r for r in q(spark, d).collect()}
    tokens_of = {i: direct("byte_bpe_50k.json", t, 0) for i, t in enumerate(texts)}
    got = by(token_files.op5_token_files)
    assert all(got[i]["ids_crc32"] == zlib.crc32(ids.tobytes()) for i, ids in tokens_of.items())
    lengths = collections.Counter()
    for r in packing.op3_packing(spark, d).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(direct("word_bpe_49k.json", t, 1)) for i, t in enumerate(texts)}
    assert {i: r["n_tokens"] for i, r in by(lm.op6_deleted_interpolation).items()} == {i: len(t.split()) + 1 for i, t in enumerate(texts)}
    assert {i: r["n_words"] for i, r in by(quality.op10_line_quality).items()} == {i: len(t.split()) for i, t in enumerate(texts)}
    hits = by(decontaminate.op4_decontaminate)
    assert [hits[i]["n_hit"] for i in range(4)] == [30, 0, 0, 30] and not hits[0]["contaminated"]
    assert set(by(pii.op7_pii)) == set(by(language.op8_language_id)) == {0, 1, 2, 3}
    assert [r["record_type"] for _, r in sorted(by(warc.op9_warc).items())] == ["response", "revisit"]
    removed = by(substrings.op2_suffix_array)
    assert (removed[3]["n_removed"], removed[3]["n_spans"]) == (len(long) - 40, 1) and removed[0]["n_removed"] == removed[1]["n_removed"] == 0


def test_pipeline_against_brute_force(spark, folder, prose):
    """All five stages over some sixty documents, each against a plain version of its rule."""
    import corpus_pipeline
    from tests.llm.test_pairs import brute_components, near_copies, words

    items = [prose(40, 501), prose(16, 502), "tiny item"]
    r = random.Random(11)
    texts = ODD + near_copies(prose, 14, 1) + [prose(50, 99)] * 3 + [prose(60, s) + f" mail bob{s}@example.com now" for s in range(300, 306)]
    texts += [f"{prose(20, s)} {items[s % 2]} {prose(20, s + 50)}" for s in range(400, 406)] + [f"{prose(2000, 7)} tiny item", "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900))]
    noise = len(texts) - 1
    d = folder(texts, items)
    spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text", f"case when doc_id = {noise} then null else lang end as lang", "source", "n_chars").write.parquet(f"{d}/labelled/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{d}/labelled/benchmark.parquet")
    d = f"{d}/labelled"
    left = {i: t for i, t in enumerate(texts) if i != noise and any(c.isalpha() for c in t or "")}  # stage 1
    places = list(left)
    groups = brute_components([left[i] for i in places])
    left = {i: left[i] for k, i in enumerate(places) if groups[k][1] == k}  # stage 2
    windows = [tuple(q[s : s + 13]) for q in map(words, items) for s in range(max(1, len(q) - 12))]

    def hit_words(t):
        w, hit = words(t), set()
        for q in windows:
            for at in range(len(w) - len(q) + 1):
                if tuple(w[at : at + len(q)]) == q:
                    hit |= set(range(at, at + len(q)))
        return len(hit), len(w)

    left = {i: t for i, t in left.items() if not (hit_words(t)[0] and 20 * hit_words(t)[0] >= hit_words(t)[1])}  # stage 3

    def without_spans(t):
        out, at = "", 0
        for kind, start, end in base_spans(t):
            if start >= at:
                out, at = out + t[at:start] + f"<{kind.upper()}>", end
            else:  # overlaps the one before
                at = max(at, end)
        return out + t[at:]

    left = {i: without_spans(t) for i, t in left.items()}  # stage 4: addresses, and numbers that happen to be cards
    rows = corpus_pipeline.run(spark, d).collect()  # stage 5
    assert {x["doc_id"] for x in rows} == set(left) and 20 < len(left) < len(texts) - 20
    for i, t in left.items():
        ids, at = direct("word_bpe_49k.json", t, 1), 0
        for x in sorted((x for x in rows if x["doc_id"] == i), key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    for s in {x["sequence_id"] for x in rows}:
        own = sorted((x["offset"], x["length"]) for x in rows if x["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_shards_of_equal_bytes(spark):
    """A third of all rows are copies of a long document, and some rows are repeated; shards still have about equal bytes."""
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(-(1 << 62), 1 << 62)), bytearray(4 * int(r.integers(5, 60)))) for i in range(3000)]
    rows += [(5000 + i, 12345 << 30, bytearray(4 * 300)) for i in range(1000)] + [(9999, 777 << 40, bytearray(4 * 100))] * 500
    encoded = spark.createDataFrame(rows, "doc_id long, near long, ids binary").repartition(8)
    got = packing.in_shards(Work(spark, "test"), encoded, 12).selectExpr("shard", "octet_length(ids) as n").groupBy("shard").sum("n").collect()
    sizes = [x[1] for x in got]
    assert {x[0] for x in got} == set(range(12)) and max(sizes) < 2 * np.median(sizes) and min(sizes) > np.median(sizes) / 2

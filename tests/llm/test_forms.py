"""Spelling variants, archives and infilling against brute force: nulls, empty and long texts, ties, repeats, clashes."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, html_text, infill, jaccard, queries, secrets, spelling, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, shortest, drop_every):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                out[run] += 1
    return out


def formed(words, times=5):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= times * n else None, len(others))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, words[w], k, words[form] if form else None))
    return rows


def test_words_are_counted_whole_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abcXYZé×÷ÿÀ"
    rows = [(None, "Straße NAÏVE naïve"), (None, None), (1, ""), (2, " \n"), (3, "Ā Āb über" + "x" * 300), (3, "Ā Āb über" + "x" * 300)]
    rows += [(k, "".join(rng.choice(letters + " -.\n") for _ in range(rng.randint(1, 400)))) for k in range(40)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, word string")
    for every in (None, 3):
        for shortest in (1, 6):
            got = {r.word: r.n for r in spelling.word_counts(df, shortest, every).where("word <> ''").collect()}
            assert got == {w: n for w, n in counted(rows, shortest, every).items() if w}
    raw, offs = common.text_buffers(pa.array([t for _, t in rows]))
    for limit in (1, 7, 64, 1000):
        parts = [(i + k, raw[o[k] : o[k + 1]].tobytes()) for i, raw, o in spelling.pieces(raw, offs, limit) for k in range(len(o) - 1)]
        texts = collections.defaultdict(bytes)
        for i, part in parts:
            texts[i] += part
        assert [texts[i].decode() for i in range(len(rows))] == [t or "" for _, t in rows]
        runs = collections.Counter(w for i, p in parts for w in re.findall("[A-Za-z\u00c0-\u00ff]+", p.decode("utf-8", "replace")))
        assert runs == collections.Counter(w for _, t in rows for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""))


def test_a_trie_finds_each_near_word_once():
    rng = random.Random(1)
    for _ in range(40):
        words = sorted({"".join(rng.choice("abé"[: rng.choice([1, 2, 3])]) for _ in range(rng.randint(1, 6))) for _ in range(60)})
        trie = spelling.Trie.of(*spelling.latin(pa.array(words)), np.arange(len(words)))
        asked = [*words, "aaa", "x", "abab", "a" * 500]
        q, w = trie.near(*spelling.latin(pa.array(asked)))
        assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == [(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if near(x, y)]
    long = ["b" * 3000, "b" * 3001, "b" * 1500 + "a" + "b" * 1500]
    trie = spelling.Trie.of(*spelling.latin(pa.array(sorted(long))), np.ones(3, int))
    q, w = trie.near(*spelling.latin(pa.array(sorted(long))))
    assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_variants_by_shards_and_rounds(spark):
    rng = random.Random(2)
    words = {}
    for stem in ("colour", "harbour", "éclairs", "banana"):
        words[stem] = 5000
        for _ in range(25):
            w = list(stem)
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice("aeioué")
            words.setdefault("".join(w), rng.choice([5, 5, 40, 900]))
    words |= {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdegg": 125, "solitary": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = formed(words)
    assert any(r[2] not in (r[0], r[1]) for r in want)
    for chars, size in ((1 << 20, 32 << 20), (40, 1), (1, 2000)):
        assert {tuple(r) for r in spelling.variants(df, 5, chars, size).collect()} == want
    none = spelling.variants(df.where("false"))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


BITS = ["\r\n", "\r", "\n", "\r\n\r\n", "WARC/1.1\r\n", "a", "é😀", "\r\r\n", "Content-Length: 5\r\n\r\n", "", " "]


def base32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    texts = [None, "", "\r\n", "\r\n\r\nWARC/1.1\r\n", "\r", "x\r", "long" * 500000] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    rows = [(i if i % 17 else None, f"http://a/ \n{i}" if i % 5 else None, h) for i, h in enumerate(texts)] + [(7000 + k, "http://hot/", "copy") for k in range(300)]
    rows += rows[:3]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(5)


def archived(rows, smallest=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[base32(h)] = min(first.get(base32(h), 1 << 60), i)
    out = collections.Counter()
    for i, _, h in rows:
        f, size = first.get(base32(h)), len((h or "").encode())
        again = f is not None and f != i and size >= smallest
        out[i, size, base32(h), "revisit" if again else "response", f if again else None] += 1
    return out


CONTRACT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_round_trip(spark, pages):
    rows, df = pages
    path, again = common.scratch_path(spark), common.scratch_path(spark)
    warc.write(warc.deduplicated(warc.responses(df)), path)
    back = warc.read(spark, path)
    found = back.collect()
    assert collections.Counter(map(tuple, warc.joined(back).select(CONTRACT).collect())) == archived(rows)
    texts = {base32(h): (h or "").encode() for _, _, h in rows}
    assert all(r.intact and (texts[r.payload_digest] == r.payload if r.record_type == "response" else r.payload is None) for r in found)
    assert len([r for r in found if r.payload == b"copy"]) == 1
    ids = {r.record_id for r in found if r.record_type == "response"}
    assert all(r.refers_to_id in ids for r in found if r.record_type == "revisit")
    assert {r.url for r in found if r.page_id == 1} == {"http://a/%20%0A1"} and {r.url for r in found if r.page_id == 5} == {None}
    warc.rewrite(spark, path, again)
    assert collections.Counter(map(tuple, warc.joined(warc.read(spark, again)).select(CONTRACT).collect())) == archived(rows)
    assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.resolve(warc.responses(df), 5).collect()) == collections.Counter((k[0], k[3], k[4]) for k in archived(rows, 5).elements())


def test_foreign_archives(spark, tmp_path):
    def record(kind, head, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    said = f"WARC-Payload-Digest: sha1:{base32('abc')}\r\n"
    parts = [
        record("warcinfo", "", b"software: x\r\n"),
        record("metadata", "", b""),
        record("response", "x-page-id: 4\r\n" + said, http + b"abc"),
        record("resource", "X-Page-ID: 9\r\n", b"abc"),
        record("revisit", "X-Page-ID: 2\r\n" + said, b""),
        record("revisit", "X-Page-ID: 3\r\nWARC-Payload-Digest: sha1:GONE\r\n", http),
        record("response", "X-Page-ID: 5\r\n" + said, http + b"abd"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts[:4]))
    got = warc.read(spark, str(tmp_path))
    assert sorted((r.page_id, r.intact) for r in got.collect()) == [(2, True), (3, True), (4, True), (4, True), (5, False), (9, True), (9, True)]
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in warc.joined(got).where("record_type = 'revisit'").collect()} == {(2, 3, 4), (3, 3, None)}
    target = common.scratch_path(spark)
    warc.rewrite(spark, str(tmp_path), target)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in warc.joined(warc.read(spark, target)).collect()}
    assert kinds == {(4, "response", None), (9, "revisit", 4), (5, "response", None), (2, "revisit", 4), (3, "revisit", None)}
    (tmp_path / "b.warc").write_bytes(parts[2][:-9])
    with pytest.raises(Exception, match="within a record"):
        warc.read(spark, str(tmp_path)).collect()


def test_no_pages(spark):
    path = common.scratch_path(spark)
    warc.write(warc.deduplicated(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))), path)
    assert warc.joined(warc.read(spark, path)).count() == 0


UNITS = {"tokens": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+", "words": r"[A-Za-z0-9_]+|[^A-Za-z0-9_]", "characters": r"[\s\S]"}


@pytest.mark.parametrize("unit", UNITS)
def test_infilling(spark, unit):
    rng = random.Random(2)
    rows = [(None, "a b c d e f"), (None, None), (1, ""), (1, "x <S> y"), (2, "  <P"), (2, "  <P"), (3, "S><M" * 9), (4, "<M>")]
    rows += [(k, "".join(rng.choice("ab \n\t_é😀- \r\x0b\u00a0<>PSM") for _ in range(rng.randint(1, 40)))) for k in range(10, 200)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, digest string, n int")
    for block, rate in ((1 << 20, 50), (3, 100), (1, 100)):
        back = infill.restored(F.col("output"), F.col("form"))
        got = collections.Counter(map(tuple, infill.transform(df, unit, rate=rate, block=block).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect()))
        want = collections.Counter()
        for d, text in rows:
            parts = re.findall(UNITS[unit], text := text or "")
            h = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
            low, high = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
            p, m, s = ("".join(x) for x in (parts[:low], parts[low:high], parts[high:]))
            if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
                row = ("plain", None, None, text)
            else:
                row = ("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
            want[d, len(parts), *row, text] += 1
        assert got == want
    assert infill.transform(df.where("false"), unit).count() == 0


def test_a_long_text_is_cut_in_blocks(spark):
    df = spark.range(1).selectExpr("id AS doc_id", "repeat('word and  more ', 300000) AS text")
    r = infill.transform(df, rate=100).collect()[0]
    parts = re.findall(UNITS["tokens"], r.text)
    h = hashlib.sha256(b"42:0").hexdigest()
    low, high = sorted(int(h[k : k + 8], 16) % (len(parts) + 1) for k in (0, 8))
    assert (r.n, r.prefix_chars, r.middle_chars) == (len(parts), len("".join(parts[:low])), len("".join(parts[low:high])))


@pytest.mark.parametrize("name", ["op11_spelling", "op12_warc", "op13_infill"])
def test_queries_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(want.columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want.fetchall())


def test_words_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    rows = ["".join(rng.choice("abAB é \n\t.") for _ in range(rng.choice([0, 1, 5, 30, 200]))).encode() for _ in range(60)]
    raw, offs = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    for member in (common.SPACED, common.LETTERS):
        monkeypatch.setattr(common, "PIECE", 1 << 20)
        whole = common.words_of(raw, offs, member)
        want = [w for r in rows for w in re.findall(rb"[^\x20\x09-\x0D]+" if member is common.SPACED else rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.lower())]
        assert [raw[a:b].tobytes().lower() for a, b in zip(whole[1], whole[2], strict=True)] == want
        assert len(set(whole[0].tolist())) == len(set(want))
        for piece in (1, 3, 17, 300):
            monkeypatch.setattr(common, "PIECE", piece)
            assert all(np.array_equal(x, y) for x, y in zip(common.words_of(raw, offs, member), whole, strict=True))


@pytest.mark.parametrize("unit", ["<div>x y z ", "<b>x y z ", "<p><b>x ", "<li><span>x ", "x</y>", "<p></b>x"])
def test_deep_and_unmatched_tags_take_linear_time(unit):
    import time

    began = time.time()
    root = html_text.parse(unit * 50_000)
    scored = html_text.containers(root)
    text = html_text.extract(unit * 50_000, scored[0][0].path if scored else None)
    assert text.count("x") == 50_000 and time.time() - began < 60


def test_planted_credentials(spark):
    """Parts in nested objects, assignments and blocks are found, and parts of different scopes are left alone."""
    rng = np.random.default_rng(4)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    key = lambda: "Aa1" + "".join(rng.choice(letters, int(rng.integers(24, 50))))
    pad = lambda: "word " * int(rng.integers(70, 200))
    texts = []
    for k in range(40):
        texts += [
            (True, f'{{"user_id": "u{k}x", "opts": {{"a": {{"b": "{pad()}"}}, "c": 1}}, "v": "{key()}"}}'),
            (True, f'}} {{"deep": {{"client_id": "c{k}x", "note": "{pad()}", "list": [{{"x": 1}}, {{"y": 2}}], "v": "{key()}"}}}}'),
            (True, f"account_id = a{k}bc\nendpoint https://h{k}.example.org/x\n{key()}"),
            (False, f'{{"user_id": "u{k}x"}} {pad()} {{"v": "{key()}"}}'),
            (False, f'{{"list": [{{"user_id": "u{k}x"}}, {{"p": "{pad()}"}}, {{"v": "{key()}"}}]}}'),
            (False, f"user_id = u{k}x\n{pad()}\n\n{pad()}\n{key()}"),
        ]
    df = common.keyed(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string"))
    found = secrets.find_secrets(df)
    assert "Python" not in found._jdf.queryExecution().toString() and "ArrowEval" not in found._jdf.queryExecution().toString()
    hit = {r.doc_id for r in found.where("name = 'weak_secret'").collect()}
    planted = {k for k, (yes, _) in enumerate(texts) if yes}
    assert len(hit & planted) >= 0.99 * len(planted) and len(hit & planted) >= 0.99 * len(hit)


@pytest.mark.parametrize("linked", [1024, 3])
def test_links_are_counted_in_parts(spark, monkeypatch, linked):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    texts = [None, "", "a", "A", "b"]
    for _ in range(4):
        base = [rng.choice(words) for _ in range(40)]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(40)] = rng.choice(words)
            texts.append(" ".join(text))
    texts += texts[5:9] + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(10)]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    want = [sum(bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    monkeypatch.setattr(jaccard, "LINKED", linked)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_groups(df, block=5).collect()}
    assert [got[k] for k in range(len(texts))] == want and max(want) > 5
    for many in (len(sets), 7):
        some = [np.array(sorted(hash(x) & (1 << 62) - 1 for x in s), np.uint64) for s in sets if s]
        shared = jaccard.overlaps(some, min(many, len(some)))
        other = some if many >= len(some) else some[many:]
        assert all(shared[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(some[:many]) for j, b in enumerate(other) if a is not b)


def test_chains_of_single_shingles_are_not_searched(spark, monkeypatch):
    chain = [" ".join(f"w{j}" for j in range(2 * k, 2 * k + 8)) for k in range(120)]  # two of four shingles shared with the next
    near = [" ".join(f"n{j}" for j in range(60)) + f" end{k}" for k in range(5)]
    rows, search = [], jaccard._search
    monkeypatch.setattr(jaccard, "_search", lambda units: rows.append(units.count()) or search(units))
    df = spark.createDataFrame(list(enumerate(chain + near)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_groups(df, block=2).collect()}
    assert got == {k: (k, 0) if k < 120 else (120, 4) for k in range(125)}
    assert rows[0] < 40  # 10 of the near ones, and pairs that a small family holds anyway


def test_pairs_of_a_bucket():
    rng = np.random.default_rng(4)
    held = [(t, s) for t in range(40) for s in rng.choice(60, rng.integers(1, 12) if t else 40, replace=False).tolist()]
    packed = np.zeros((len(held), 12), np.uint8)
    packed[:, 0], packed[:, 5] = np.array(held).T
    want = collections.Counter(p for t in range(1, 40) for p in itertools.combinations(sorted(s for x, s in held if x == t), 2))
    first = min(s for t, s in held if t == 0)
    want.update({(first, s): jaccard.TOGETHER for t, s in held if t == 0 and s != first})
    assert {(a, b): n for a, b, n in jaccard._bucket_pairs(packed).tolist()} == want
    assert jaccard._bucket_pairs(packed[:0]).shape == (0, 3)

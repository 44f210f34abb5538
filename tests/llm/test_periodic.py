"""op11 against a brute-force search of every stretch."""

import hashlib
import random
import time
import zlib

import numpy as np

from quire.llm import periodic


def brute(words):
    """(start, end, period) of every maximal stretch, its smallest period found by trying all."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            start, end = i, e + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(6, 4 * q) and not smaller:
                out.add((start, end, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_short_and_random_words():
    rng = random.Random(0)
    for case in range(1500):
        n, k = rng.randint(0, 60), rng.choice((1, 2, 2, 3))
        words = [rng.choice("abc"[:k]) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if words:
                p, at = rng.randint(1, 8), rng.randrange(len(words))
                words[at:at] = (words[at : at + p] or ["a"]) * rng.randint(2, 7)
        assert [tuple(r) for r in periodic.find(words).tolist()] == brute(words), words


def test_blocks_and_failed_hashes(monkeypatch):
    rng = random.Random(2)
    texts = [[rng.choice("ab") for _ in range(rng.randint(20, 90))] + list("abc") * 9 for _ in range(60)]
    want = [brute(t) for t in texts]
    monkeypatch.setattr(periodic, "BLOCK", 7)
    assert [[tuple(r) for r in periodic.find(t).tolist()] for t in texts] == want
    own, seeds = periodic.Hashes.equal, []

    class Weak(periodic.Hashes):  # the first hashes take everything for equal
        def __init__(self, ids, seed):
            super().__init__(ids, seed)
            self.weak = seed == 0
            seeds.append(seed)

        def equal(self, i, q, n):
            return np.ones(len(i), bool) if self.weak else own(self, i, q, n)

    monkeypatch.setattr(periodic, "Hashes", Weak)
    assert [[tuple(r) for r in periodic.find(t).tolist()] for t in texts] == want
    assert 1 in seeds


def test_long_texts_are_searched_whole():
    start = time.perf_counter()
    words = [str(i) for i in range(150_000)] + ["x"] * 100_000 + [str(-i) for i in range(1000)] * 5
    assert [tuple(r) for r in periodic.find(words).tolist()] == [(150_000, 250_000, 1), (250_000, 255_000, 1000)]
    assert [tuple(r) for r in periodic.find(["a", "b"] * 150_000).tolist()] == [(0, 300_000, 2)]
    assert time.perf_counter() - start < 60


TEXTS = [None, "", " \t\n ", "a", "x x x x x x", "a b a b a b a b", "z a b a b a b a b a y", "é é é é é é é A a", "one two three " * 8 + "end", "w " * 5000, "no run in here at all", "a a a a a a b a a a a a a b " * 5]


def rows(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 80))) for _ in range(150)]
    out = [(i, t, i, "p", "q") for i, t in enumerate(texts)] + [(None, "x x x x x x x", 1, "p", "q"), (4, TEXTS[4], 4, "p", "q")]
    return out, spark.createDataFrame(out, "doc_id long, text string, start long, period string, key string")


def test_digest_equals_brute_force(spark):
    data, docs = rows(spark)
    got = sorted((tuple(r) for r in periodic.digest(docs).collect()), key=str)
    want = []
    for i, t, *_ in data:
        words = (t or "").split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        found = brute(words) if len(words) < 500 else [(0, len(words), 1)]
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = max(found, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
        four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        text = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(w[1] for w in want) > 60 and periodic.digest(docs.limit(0)).count() == 0


def test_spans_and_collapse(spark):
    data, docs = rows(spark)
    got = sorted((r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic.spans(docs).collect() if r["doc_id"] is not None)
    want = [(i, s, e - s, q) for i, t, *_ in data if i is not None and i != 9 for s, e, q in brute((t or "").split())] + [(9, 0, 5000, 1)]
    assert got == sorted(want)
    out = periodic.collapse(docs)
    assert out.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] is None and texts[2] == " \t\n " and texts[5] == "a b" and texts[6] == "z a b y" and texts[7] == "é A a" and texts[10] == TEXTS[10] and texts[None] == "x"

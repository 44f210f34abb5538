"""Alignment against enumeration and against another implementation of matching blocks."""

import random
import time
from collections import namedtuple
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

from quire.operators import align

Line = namedtuple("Line", "doc_id pos raw canonical")


def enumerated(plan, host):
    """Candidates of every plan line, by the best weights of all prefixes and suffixes."""
    score = lambda i, j: 100 if plan[i].raw == host[j].raw else 80 if plan[i].canonical == host[j].canonical else 0

    @lru_cache(None)
    def ahead(i, j):
        if not i or not j:
            return 0
        s = score(i - 1, j - 1)
        return max(ahead(i - 1, j), ahead(i, j - 1), ahead(i - 1, j - 1) + s if s else 0)

    @lru_cache(None)
    def behind(i, j):
        if i == len(plan) or j == len(host):
            return 0
        s = score(i, j)
        return max(behind(i + 1, j), behind(i, j + 1), behind(i + 1, j + 1) + s if s else 0)

    most = ahead(len(plan), len(host))
    return [[j for j in range(len(host)) if score(i, j) and ahead(i, j) + score(i, j) + behind(i + 1, j + 1) == most] for i in range(len(plan))]


def test_alignment_equals_enumeration():
    rng = random.Random(0)
    for case in range(400):
        letters = "abcdefgh"[: rng.choice((2, 4, 8))]
        side = lambda n: [Line(1, 10 * i, c + rng.choice(("", "", " ")), c) for i, c in enumerate(rng.choice(letters) for _ in range(n))]
        plan, host = side(rng.randint(0, 12)), side(rng.randint(0, 12))
        if case % 3 == 0:  # mostly the same lines
            host = [p for p in plan if rng.random() < 0.8] + host[:2]
            host = [Line(1, 10 * i, h.raw, h.canonical) for i, h in enumerate(host)]
        for got, want, p in zip(align.align(plan, host), enumerated(plan, host), plan):
            one = len(want) == 1
            status = ("matched_unique" if host[want[0]].raw == p.raw else "matched_review") if one else "ambiguous" if want else "unmatched"
            assert got == (1, p.pos, status, host[want[0]].pos if one else None, len(want))


def test_long_documents_in_small_memory():
    rng = random.Random(1)
    plan = [Line(1, i, f"{i}" if i % 3 else f"r{rng.randrange(40)}", "x") for i in range(20_000)]
    plan = [p._replace(canonical=p.raw) for p in plan]
    host = [p for i, p in enumerate(plan) if i % 11]
    start = time.perf_counter()
    out = align.align(plan, host)
    assert len(out) == 20_000 and sum(r[2] == "matched_unique" for r in out) > 12_000
    assert time.perf_counter() - start < 60
    same = [Line(1, i, "same", "same") for i in range(1500)]
    assert [r[4] for r in align.align(same, same[:-1])] == [1, *[2] * 1498, 1]  # each line its own place or the one before
    assert {r[2] for r in align.align(same, same)} == {"matched_unique"}


def test_blocks_equal_difflib(monkeypatch):
    rng = random.Random(2)
    for limit in (64, 0):
        monkeypatch.setattr(align, "MOST_POINTS", limit)
        for _ in range(300):
            letters = "abcdefghijkl"[: rng.choice((1, 3, 12))]
            a = [rng.choice(letters) for _ in range(rng.randint(0, 25))]
            b = [x for x in a if rng.random() < 0.8] + [rng.choice(letters) for _ in range(rng.randint(0, 9))]
            got = {i + k: j + k for i, j, n in align.blocks(*align._ids(a, b)) for k in range(n)}
            m = SequenceMatcher(None, a, b, autojunk=False)
            assert got == {x.a + k: x.b + k for x in m.get_matching_blocks() for k in range(x.size)}, (a, b)
    assert align.blocks(np.arange(20_000), np.concatenate([np.arange(10_000, 20_000), np.arange(10_000)])) == [(0, 10_000, 10_000)]


def test_regions_keep_lines_apart(spark):
    schema = "doc_id long, pos int, region string, identity string"
    a = spark.createDataFrame([(1, 0, "front", "x"), (1, 1, "body", "x"), (1, 2, "body", None), (1, 3, "body", "y"), (2, 0, "body", "z")], schema)
    b = spark.createDataFrame([(1, 0, "body", "x"), (1, 1, "body", None), (1, 2, "tail", "y"), (3, 0, "body", "z")], schema)
    got = sorted((r["doc_id"], r["region"], r["pos"], r["other"]) for r in align.region_pairs(a, b).collect() if r["pos"] is not None)
    assert got == [(1, "body", 1, 0), (1, "body", 2, None), (1, "body", 3, None), (1, "front", 0, None), (2, "body", 0, None)]
    assert sorted((r["doc_id"], r["region"], r["other"]) for r in align.region_pairs(a, b).where("pos is null").collect()) == [(1, "body", 1), (1, "tail", 2), (3, "body", 0)]


def test_identities_and_bindings(spark):
    t = spark.createDataFrame([("一、总体要求。",), ("（二）总体要求",), ("二〇二四年三月五日",), ("2024年3月5日",), (" ",), ("正文。",)], "t string")
    got = t.select(align.identity(t.t).alias("i")).select("i.*").collect()
    assert [r["reason"] for r in got] == ["heading_number_normalization", "heading_number_normalization", "date_normalization", "date_normalization", "empty", "exact_text"]
    assert got[0]["identity"] == got[1]["identity"] and got[2]["identity"] == got[3]["identity"] and got[4]["identity"] is None

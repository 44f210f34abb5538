"""The pipeline's near-duplicates against brute force."""

import random

import corpus_pipeline
import pytest
from quire.llm import neardup
from quire.llm.simhash import fingerprint


@pytest.mark.parametrize("block", [512, 4])
def test_near_copies_of_ordinary_length_go(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BUCKET", 4)
    monkeypatch.setattr(neardup, "BLOCK", block)  # of several blocks to a bucket with 4
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(80, 300))]
        for _ in range(9):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    sets = [set(neardup.shingles(t).tolist()) for t in texts]
    part = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(part)) and len(got) < 40


def test_fingerprints_link_too(spark):
    """op2's fingerprints take part: the first two texts have one, though they share few shingles."""
    rng = random.Random(4)
    own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(4)]
    texts = ["red green blue " * 200 + own[0], "red green blue " * 200 + own[1], own[2], own[3], own[3] + " end"]
    assert fingerprint(texts[0]) == fingerprint(texts[1]) and fingerprint(own[2]) != fingerprint(own[3])
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]


def test_bands_are_not_broadcast(spark, monkeypatch):
    plans, stored = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    neardup.classes(spark.createDataFrame([("a b c d e f",), ("a b c d e f g",)], "text string"))
    joins = [x for p in plans for x in p.splitlines() if "Join" in x and "b_v" in x and "Inner" in x]
    assert joins and not any("Broadcast" in x for x in joins)

"""Samples, places of an order, devices and acknowledgements against plain Python."""

import random

from pyspark.sql import functions as F

from quire.operators import accounts, locate, ranked


def test_rows_at_places(spark):
    rng = random.Random(0)
    ids = rng.sample(range(10**6), 3000)
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "id long, name string").repartition(7)
    places = sorted(rng.sample(range(3000), 40)) + [5000]
    got = sorted(r["id"] for r in ranked.at_places(rows, "id", places).collect())
    assert got == [sorted(ids)[p] for p in places[:-1]]
    assert ranked.at_places(rows.limit(0), "id", [0]).count() == 0


def test_samples_put_risk_first(spark):
    def sample(records, size):
        risky = sorted((r for r in records if r[1] > 0), key=lambda r: (-r[1], r[0]))[:size]
        rest, need = sorted(r for r in records if r[1] <= 0), size - len(risky)
        if need <= 0 or not rest:
            return risky
        if len(rest) <= need:
            return risky + rest
        places = {len(rest) // 2} if need == 1 else {round(k * (len(rest) - 1) / (need - 1)) for k in range(need)}
        return risky + [rest[p] for p in sorted(places)]

    rng = random.Random(1)
    for n, risk, size in ((100, 0.1, 30), (100, 0.6, 30), (10, 0.2, 30), (50, 0.0, 1), (40, 0.02, 2), (0, 0, 5)):
        records = [(i, rng.randint(1, 5) if rng.random() < risk else 0) for i in range(n)]
        got = accounts.sampled(spark.createDataFrame(records, "id long, risk long"), size).collect()
        assert sorted(map(tuple, got)) == sorted(sample(records, size)), (n, risk, size)


def test_devices_and_acknowledgements(spark):
    devices = spark.createDataFrame([(1, "a", "old", 10, 20, 3), (2, "a", "old", 10, 20, 1)], "user_id long, fingerprint string, name string, created long, seen long, logins long")
    logins = spark.createDataFrame([(1, "a", "x", 15), (1, "a", "y", 18), (3, "a", "new", 5), (3, "a", "newer", 7), (None, "a", "z", 1)], "user_id long, fingerprint string, name string, second long")
    got = {r["user_id"]: tuple(r)[2:] for r in accounts.signed_in(devices, logins).collect()}
    assert got[1] == ("y", 10, 20, 5, False) and got[2] == ("old", 10, 20, 1, False) and got[3] == ("newer", 5, 7, 2, True)
    notes = spark.createDataFrame([(1, 1, 0), (2, 1, 9), (3, 1, 0), (4, 1, 0)], "id long, user_id long, at long")
    acks = spark.createDataFrame([(1, 1, 30), (1, 1, 20), (2, 1, 50), (3, 2, 40)], "id long, user_id long, second long")
    assert {r["id"]: (r["at"], r["changed"]) for r in accounts.acknowledged(notes, acks).collect()} == {1: (20, True), 2: (9, False), 3: (0, False), 4: (0, False)}


def test_fragments_in_order(spark):
    cases = [("abcabc", ["abc", "abc", "abc"], [(0, 3), (3, 6), None]), ("a b a", ["a", "x", " b ", "a"], [(0, 1), None, (1, 4), (4, 5)]), ("ab", ["", " b "], [(0, 0), (1, 2)]), ("", ["a"], [None])]
    rows = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i int, t string, f array<string>")
    got = {r["i"]: [None if x["start"] is None else (x["start"], x["end"]) for x in r["x"]] for r in rows.select("i", locate.searched(F.col("t"), F.col("f")).alias("x")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}

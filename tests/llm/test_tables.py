"""op3, op7, op9, components and the pipeline against brute force."""

import base64
import gzip
import hashlib
import random

import numpy as np

from quire.llm import common, embdedup, mtree, warc


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int, v string")


def some_vectors(n=700, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:160] = x[99] + 0.02 * rng.normal(size=(60, d)).astype(np.float32)
    x[200:240] = x[199]
    rows = [(i, [float(c) for c in v], int(i % 3) if i < 90 or i > 240 else 1, 1, "x") for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * d, [nan] * d, [inf] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0]]
    rows += [(n + i, v, 1, 1, "x") for i, v in enumerate(odd)]
    return rows + [(n + 20, rows[0][1], None, 1, "x"), (None, rows[0][1], 0, 1, "x"), rows[5]]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    rows = [r for r in some_vectors() if r[0] is None or r[0] != 5 or True]
    data = vectors_of(spark, rows)
    got = mtree.top_k(data, data.where("vec_id % 20 = 0"), shard_rows=200)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())
    use = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, *_ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    pad = lambda v: np.pad(v, (0, 12 - len(v)))
    for q, x in use:
        if q % 20 == 0:
            best = sorted(((-int(pad(x) @ pad(y)), i) for i, y in use if i != q))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_search_saves_distances_and_handles_equal_points():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (20, 8))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int64)
    tree = mtree.Tree(x, np.arange(4000))
    found, computed = tree.search(x[7], 7, 10)
    scores = x @ x[7]
    scores[7] = -(1 << 60)
    assert [s for s, _ in found] == sorted(scores.tolist(), reverse=True)[:10]
    assert computed < 2000
    same = mtree.Tree(np.ones((3000, 4), np.int64), np.arange(3000))
    assert same.search(np.ones(4, np.int64), 1, 4)[0] == [(4, 0), (4, 2), (4, 3), (4, 4)]


def test_top_k_of_components_of_any_size(spark):
    rng = np.random.default_rng(3)
    size = np.float32(10.0) ** rng.integers(-3, 38, 300).astype(np.float32)
    x = (rng.normal(size=(300, 3)).astype(np.float32) * size[:, None]).clip(-3e38, 3e38)
    rows = [(i, [float(c) for c in v], 0, 1, "x") for i, v in enumerate(x)] + [(400, [200000.0, 1.0], 0, 1, "x"), (401, [1.0, 2.0], 0, 1, "x"), (500, [1.0, 1.0], 0, 1, "x")]
    data = vectors_of(spark, rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(data, data.where("vec_id % 25 = 0"), shard_rows=100).collect())
    whole = {i: [int(np.floor(1024 * c)) if abs(c) < 2**43 else int(1024 * c) for c in v] for i, v, *_ in rows}
    want, far = [], 0
    for q in (i for i in whole if i % 25 == 0):
        exact = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        far += sum(abs(s) >> 63 > 0 for s in exact.values())
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), i) for i, s in exact.items())[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and far > 500


def test_top_k_with_few_candidates_and_none(spark):
    data = vectors_of(spark, [(0, [1.0, 2.0], 0, 1, "x"), (1, [3.0, 1.0], 0, 1, "x")])
    assert [(r["vec_id"], r["rank"]) for r in mtree.top_k(data, data.where("vec_id = 0")).collect()] == [(1, 1)]
    assert mtree.top_k(data.limit(0), data.limit(0)).count() == 0


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "CELL", 40)
    monkeypatch.setattr(embdedup, "BLOCK", 32)
    rows = some_vectors()[:-1]
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(vectors_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    valid = [(i, np.array(v, float), lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, parent = dict.fromkeys(got, 0), {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x, p) in enumerate(valid):
        for j, y, q in valid[:a]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i] += 1
                links[j] += 1
                u, v = sorted((root(i), root(j)))
                parent[v] = u
    assert sum(links.values()) > 1000
    for i, r in got.items():
        if i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], root(i), root(i) == i), i
    assert (got[None]["n_links"], got[None]["component_id"]) == (0, None)
    assert embdedup.near_duplicates(vectors_of(spark, rows).limit(0)).count() == 0


def pages_of(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 7)}</p>" if i % 5 else "same page") for i in range(200)]
    rows += [(300, None, None), (301, "http://h/a b\n", ""), (None, "http://h/n", "same page"), (302, "u", "x" * 200_000), (5, "http://h/5", "same page")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string"), rows


def test_warc_round_trip(spark, tmp_path):
    pages, rows = pages_of(spark)
    folder = f"file://{tmp_path}/a"
    warc.write(pages, folder, shard_bytes=30_000, roll_bytes=4_000)
    got = [tuple(r) for r in warc.read(spark, folder).drop("url").collect()]
    body = lambda t: (t or "").encode()
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[body(t)] = max(last.get(body(t), -1), i)
    want = []
    for i, _, t in rows:
        first = last.get(body(t))
        again = i is not None and first != i
        want.append((i, len(body(t)), base64.b32encode(hashlib.sha1(body(t)).digest()).decode(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    manifest = sorted((r.asDict() for r in warc.manifest(spark, folder).collect()), key=lambda m: m["file"])
    assert len(manifest) > 2 and sum(m["records"] for m in manifest) == len(rows)
    order = []
    for m in manifest:
        data = open(f"{tmp_path}/a/{m['file']}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == m["sha256"] and len(data) == m["bytes"]
        order += [int(line.split(b": ")[1]) for line in gzip.decompress(data).split(b"\r\n") if line.startswith(b"WARC-Page-ID")]
    assert order == sorted(order)
    warc.write(pages.repartition(7), f"file://{tmp_path}/b", shard_bytes=30_000, roll_bytes=4_000)
    assert sorted((r.asDict() for r in warc.manifest(spark, f"file://{tmp_path}/b").collect()), key=lambda m: m["file"]) == manifest
    assert max(int(m["file"].split("-")[2][:4]) for m in manifest) > 0  # a shard that rolled


def test_warc_repeated_ids_and_many_rows_without_one(spark, tmp_path):
    rows = [(7, "u", "first"), (7, "u", "second"), (7, "u", "first"), (9, "u", "first"), *[(None, f"n{i}", f"text {i % 50} " * 40) for i in range(300)]]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, shard int, refers long")
    warc.write(pages, f"file://{tmp_path}/a", shard_bytes=20_000, roll_bytes=1_000)
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got if r["page_id"]) == sorted([(7, "response", 0, 6), (7, "revisit", 9, 5), (7, "revisit", 9, 5), (9, "response", 0, 5)])
    assert sum(r["page_id"] is None for r in got) == 300 and all(r["record_type"] == "response" for r in got if r["page_id"] is None)


def test_warc_minimum_size_and_empty_table(spark, tmp_path):
    pages, rows = pages_of(spark)
    warc.write(pages, f"file://{tmp_path}/a", min_bytes=10_000)
    assert {r["record_type"] for r in warc.read(spark, f"file://{tmp_path}/a").collect()} == {"response"}
    warc.write(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read(spark, f"file://{tmp_path}/b").count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, 500 + i) for i in range(1, 60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    assert got == {i: root(i) for i in parent}


def test_query_links_across_many_open_cells(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "CELL", 24)
    monkeypatch.setattr(embdedup, "BLOCK", 512)
    rng = np.random.default_rng(5)
    x = np.ones(48) + 0.15 * rng.normal(size=(1200, 48))  # diffuse: links cross 50 cells that all are open
    rows = [(i, [float(c) for c in v], 1, 1, "x") for i, v in enumerate(x.astype(np.float32))]
    u = embdedup.unit(np.array([v for _, v, *_ in rows], float))
    hit = u @ u.T >= 0.98
    want = hit.sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_duplicates(vectors_of(spark, rows)).collect()}
    assert want.sum() > 1000 and [got[i] for i in range(len(x))] == want.tolist()

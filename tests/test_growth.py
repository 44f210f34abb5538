"""Plans whose memory must not grow with the number of levels or names: one sort serves all running counts."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quire.functions import kernels
from quire.operators import align, context, contracts, normalization, outline, packages, parts, rope, spans


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_repaired_in_one_sort(spark):
    rows = [(1, i, k, n) for i, (k, n) in enumerate([("heading1", "二、"), ("heading2", "（三）"), ("heading2", "（三）"), ("heading1", "x"), ("heading2", "（一）"), ("attachment_page_mark", ""), ("heading2", "（五）")])]
    out = normalization.repaired(spark.createDataFrame(rows, "doc_id long, pos int, type string, number string"))
    assert [r["expected"] for r in out.orderBy("pos").collect()] == [1, 1, 2, None, 3, None, 1]
    assert plan(out).count("Sort [") == 1


def test_counters_need_one_sort(spark):
    levels = [1, 2, 2, 3, 2, 3, 1, 3, 2, 0, 4, 4, 3, 4]
    out = outline.counters(spark.createDataFrame([(1, i, x) for i, x in enumerate(levels)], "doc_id long, pos int, level int"))
    want, counts = [], [0] * 4
    for x in levels:
        if x:
            counts[x - 1 :] = [counts[x - 1] + 1, *[0] * (4 - x)]
        want.append(tuple(counts))
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in out.orderBy("pos").collect()] == want
    assert plan(out).count("Sort [") == 1


def test_needed_parts_are_no_distinct_count(spark, tmp_path):
    spark.createDataFrame([(1, i, 10 + i, 5.0) for i in range(1, 4)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = packages.archive_verdict(spark, str(tmp_path))
    assert [(r["members"], r["rule"]) for r in out.collect()] == [(3, None)] and "distinct" not in plan(out)


def test_places_are_searched_not_looked_at_one_by_one(spark):
    texts = ["", "。", "a。b。。", "无", "各部门要各部门要。😀各部门要"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    for old in ("。", "各部门要"):
        got = t.select("t", spans.spots(F.col("t"), old).alias("s"), rope.matches(F.col("t"), [(old, "x")]).alias("m")).collect()
        want = {x: [i for i in range(len(x)) if x.startswith(old, i)] for x in texts}
        assert {r["t"]: r["s"] for r in got} == want
        assert {r["t"]: [(m["start"], m["end"]) for m in r["m"]] for r in got} == {x: [(i, i + len(old)) for i in s] for x, s in want.items()}


def test_contract_records_are_parsed_once(spark):
    rows = [(1, "[1"), (2, "{}"), (3, '{"blocks": null, "extra": 1, "paragraphs": [null, {"host_paragraph_id": "p"}, {"host_paragraph_id": "p"}]}'), (4, '{"blocks": [{"block_id": "b\\"1"}, null, {"block_id": "b\\"1"}], "review_items": [{"block_id": "none"}]}'), (5, None)]
    records = spark.createDataFrame(rows, "id long, json string").repartition(1)
    for check in (contracts.plan_issues, contracts.snapshot_issues, contracts.binding_issues):
        assert plan(check(records)).count("from_json(") == 1
    found = {(r["id"], r["path"], r["reason"]) for r in contracts.plan_issues(records).collect()}
    assert {(1, "$", "no_object"), (5, "$", "no_object"), (3, "$.extra", "unknown_field"), (4, "$.blocks[2].block_id", "duplicate_id"), (4, "$.blocks[1].physical_group_id", "stable_id_mismatch")} <= found
    assert not any(i in (1, 5) and p != "$" for i, p, _ in found) and not any(i in (2, 3) and "[" in p for i, p, _ in found)
    of_snapshots = {(r["id"], r["path"], r["reason"]) for r in contracts.snapshot_issues(records).collect() if r["reason"]}
    assert of_snapshots >= {(3, "$.paragraphs[2].host_paragraph_id", "duplicate_id"), (3, "$.blocks", "unknown_field")} and (3, "$.paragraphs[1].host_paragraph_id", "duplicate_id") not in of_snapshots


def test_json_parts_are_quoted_like_json(spark):
    texts = ["", "abc", 'a"b', "a\\b", "a\nb\t\x01", "[中]/😀", "x \x7f", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", contracts.json_part(F.col("t")).alias("j"), F.to_json(F.array("t")).alias("whole")).collect()
    assert all(f"[{r['j']}]" == r["whole"] for r in got)


def test_tokens_are_found_once(spark):
    xml = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">a page &lt;b&gt;</w:t></w:r><w:r><w:t></w:t><w:t>c > d &amp;lt;</w:t><w:tab/><w:br/><w:br w:type="x"/></w:r><w:r><w:t>\n</w:t><w:br w:type="page"/></w:r></w:p>'
    want = [("text", "a page <b>c > d &lt;"), ("tab", "\t"), ("line_break", "\n"), ("text", "\n"), ("page_break", "")]
    t = spark.createDataFrame([(1, xml), (2, "<w:p></w:p>"), (3, None), (4, "")], "id long, x string").repartition(1)
    got = {r["id"]: r["t"] and [tuple(x) for x in r["t"]] for r in t.select("id", parts.tokens(F.col("x")).alias("t")).collect()}
    assert got == {1: want, 2: [], 3: None, 4: []}
    b = parts.blocks(t.select(F.col("id").alias("doc_id"), F.col("x").alias("document")))
    assert [(r["doc_id"], r["at"], r["kind"]) for r in b.orderBy("doc_id").collect()] == [(1, 0, "p"), (2, 0, "p")]
    assert plan(b).count("regexp_extract_all") == 1


def test_formats_beside_a_place(spark):
    """Against a look at every character; runs may overlap, leave gaps and end behind the text."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = "".join(rng.choice("ab。 \n​　😀") for _ in range(rng.randint(0, 9)))
        runs = [(rng.randint(0, 8), rng.randint(0, 11), rng.random() < 0.5, rng.choice((14, 15, None)), rng.choice(("", "x", "y"))) for _ in range(rng.randint(0, 4))]
        rows.append((i, text, rng.randint(0, len(text)), runs))
    df = spark.createDataFrame(rows, "id int, text string, at int, runs array<struct<start:int,end:int,bold:boolean,size:int,font:string>>")
    low = lambda x: (x[2], x[3] is not None, x[3] or 0, x[4])

    def near(text, runs, places):
        return next((min(own, key=low) for p in places if spans.visible(text[p]) for own in [[r for r in runs if r[0] <= p < r[1]]] if own), None)

    plain = ~F.col("text").rlike(spans.INVISIBLE)
    got = df.select("id", spans.differs(F.col("text"), F.col("runs"), F.lit(0), F.col("at"), F.length("text")).alias("d"), spans.bold_share(F.col("text"), F.col("runs"), F.lit(0), F.col("at"), plain).alias("s")).collect()
    for r in got:
        _, text, at, runs = rows[r["id"]]
        a, b = near(text, runs, range(at - 1, -1, -1)), near(text, runs, range(at, len(text)))
        assert r["d"] == (a is not None and b is not None and (a[2] != b[2] or (a[3] is not None and b[3] is not None and a[3] >= b[3] + 1) or (a[4] != "" and b[4] != "" and a[4] != b[4]))), rows[r["id"]]
        sums = [(spans.visible(text[max(0, x[0]) : min(at, x[1])]) if x[0] < min(at, x[1]) else 0, x[2]) for x in runs]
        whole = sum(n for n, _ in sums)
        assert r["s"] == (sum(n for n, bold in sums if bold) / whole if whole else 0.0), rows[r["id"]]
    # Only where no run holds the nearest visible character, runs are looked through by their texts.
    assert plan(df.select(spans.differs(F.col("text"), F.col("runs"), F.lit(0), F.col("at"), F.length("text")))).count("trim(") >= 2


def test_workers_hold_few_texts_at_once(spark):
    seen = kernels._kernel("n int, t string")(lambda texts: pd.DataFrame({"n": len(texts), "t": texts}))
    texts = [None if i % 7 == 0 else f"ａ  {i} " for i in range(500)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1)
    got = df.select(seen(F.col("t")).alias("s"), "t").collect()
    assert max(r["s"]["n"] for r in got) == kernels.HELD and [r["s"]["t"] for r in got] == texts
    both = df.select(kernels.normalized(F.col("t")).alias("n"), F.sha2(kernels.normalize_text(F.col("t")), 256).alias("d"), kernels.width_of(F.col("t")).alias("w")).collect()
    assert all((r["n"]["text_sha256"], r["n"]["width"]) == (r["d"], r["w"]) for r in both) and both[0]["d"] is None and both[0]["w"] == 0
    assert df.limit(0).select(kernels.normalized(F.col("t"))).collect() == []


def test_context_keeps_one_order(spark):
    rows = [(1, i, t, False, False, 14, None) for i, t in enumerate(["关于开展工作的报告", "", "某某市人民政府", "一、总体要求", "各部门要认真落实各项任务，按时完成年度目标。", "某某市财政局", "2024年3月5日"])]
    df = spark.createDataFrame(rows, "doc_id long, pos long, text string, centred boolean, bold boolean, size int, style string")
    out = context.with_tail(context.with_context(context.facts(df)))
    assert plan(out).count("Sort [") == 1
    assert [(r["pos"], r["signature"]) for r in out.where("signature is not null").orderBy("pos").collect()] == [(5, "following-date"), (6, "previous-signature-org")]


def test_steps_of_an_identity_are_columns(spark):
    texts = ["", "  一、  总体要求 。", "（二）a", "2024 年3月5日", "a  b", "3.", None]
    t = spark.createDataFrame([(x,) for x in texts], "x string").repartition(1)
    out = align.with_identity(t, F.col("x"))
    assert out.columns == ["x", "i"]
    got = {r["x"]: r["i"] for r in out.collect()}
    assert got == {r["x"]: r["i"] for r in t.select("x", align.identity(F.col("x")).alias("i")).collect()}

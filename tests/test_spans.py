"""Interval join and span plan against brute force and known results."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.operators import intervals, spans


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(0)
    left, right = [], []
    for i in range(900):
        a = rng.choice((rng.randrange(1000), rng.randrange(30)))  # dense at the start
        left.append((rng.choice((1, 1, 1, 2, None)), i, a, a + rng.choice((0, 1, 3, 900))))
        a = rng.randrange(1000)
        right.append((rng.choice((1, 1, 2, 3, None)), i, a, a + rng.choice((0, 1, 7, 400))))
    right.append((1, 900, -5, 2000))  # one that meets nearly all
    a = spark.createDataFrame(left, "key int, l int, s int, e int")
    b = spark.createDataFrame(right, "key int, r int, x int, y int")
    want = sorted((p[1], q[1]) for p in left for q in right if p[0] is not None and p[0] == q[0] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and p[3] > q[2])
    for per_bin in (3, 64):
        got = intervals.interval_join(a, b, "key", ("s", "e"), ("x", "y"), per_bin)
        assert got.columns == ["key", "l", "s", "e", "r", "x", "y"]
        assert sorted((r["l"], r["r"]) for r in got.collect()) == want
    assert intervals.interval_join(a.limit(0), b, "key", ("s", "e"), ("x", "y")).count() == 0


def plan(spark, texts, report=True, runs=()):
    rows = [Row(doc_id=1, para=i, text=t, report=report, runs=[Row(start=a, end=b, bold=c, size=14, font="") for a, b, c in runs]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, para long, text string, report boolean, runs array<struct<start:int,end:int,bold:boolean,size:int,font:string>>")
    out = {}
    for r in sorted(spans.span_plan(df).collect(), key=lambda r: (r["para"], r["segment"])):
        out.setdefault(r["para"], []).append(r["text"][r["start"] : r["end"]])
    return [out.get(i, []) for i in range(len(texts))]


def test_plans_of_known_paragraphs(spark):
    assert plan(spark, ["", "  \n ", "一、总体要求。各部门要认真落实。确保实效。", "（一）总体要求。各部门要认真落实。", "一年来。各项工作取得新的成效。"]) == [
        [], [], ["一、总体要求。", "各部门要认真落实。确保实效。"], ["（一）总体要求。各部门要认真落实。"], ["一年来。", "各项工作取得新的成效。"],
    ]
    assert plan(spark, ["一年来。各项工作取得新的成效。"], report=False) == [["一年来。各项工作取得新的成效。"]]
    assert plan(spark, ["三、原因如下：认识不足。各部门要抓紧整改。"]) == [["三、原因如下：认识不足。各部门要抓紧整改。"]]
    # The same with a change of format at the stop is a heading with its body.
    assert plan(spark, ["三、原因如下：认识不足。各部门要抓紧整改。"], runs=[(0, 12, True), (12, 21, False)]) == [["三、原因如下：认识不足。", "各部门要抓紧整改。"]]
    # Without a number a change of format cuts only before the body region.
    bold = [(0, 7, True), (7, 30, False)]
    assert plan(spark, ["加强组织领导。各部门要认真落实。", "一、要求", "加强组织领导。各部门要认真落实。"], runs=bold) == [["加强组织领导。", "各部门要认真落实。"], ["一、要求"], ["加强组织领导。各部门要认真落实。"]]
    assert plan(spark, ["各位代表：现在报告工作。"]) == [["各位代表：", "现在报告工作。"]]
    assert plan(spark, ["2.措施。各单位抓好落实工作。\n请按时完成\n某某市财政局", "2024年3月5日"]) == [["2.措施。", "各单位抓好落实工作。\n请按时完成", "某某市财政局"], ["2024年3月5日"]]
    assert plan(spark, ["一、要求。请抓好落实工作\n某某市财政局2024年3月5日\n附件：方案"]) == [["一、要求。", "请抓好落实工作", "某某市财政局", "2024年3月5日", "附件：方案"]]
    assert plan(spark, ["某某局的工作\n继续推进"]) == [["某某局的工作\n继续推进"]]


def test_no_visible_character_is_lost(spark):
    rng = random.Random(1)
    parts = ["一、", "（二）", "要求", "。", "：", "各位代表", "\n", " ", "​", "某某市财政局", "2024年3月5日", "附件", "各部门要认真落实", "1:2", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    runs = [(0, 4, True), (4, 9, False), (9, 200, True)]
    for t, found in zip(texts, plan(spark, texts, runs=runs)):
        assert spans.visible("".join(found)) == spans.visible(t), t
        assert all(x and not spans._INVISIBLE.match(x[0]) and not spans._INVISIBLE.match(x[-1]) for x in found)


def test_runs_are_placed_in_their_own_row(spark):
    texts = ["Eins. Zwei 😀. Drei.\nVier", "", None, "ab. ", "\n\nx. y\n", "no stop"]
    pieces = spark.createDataFrame([(i, t, None if t is None else [*(p + ". " for p in t.split(". ")[:-1]), t.split(". ")[-1]]) for i, t in enumerate(texts)], "doc_id long, text string, owns array<string>").coalesce(1)
    placed = intervals.cursor(pieces, F.when(F.col("n") == 1, F.upper("own")).otherwise(F.col("own")))
    want = []
    for r in pieces.collect():
        at = 0
        for n, own in enumerate(r["owns"] or ()):
            said = own.upper() if n == 1 else own
            want.append((r["doc_id"], n, own, at + len(own), at, said == r["text"][at : at + len(own)], bool(own.strip())))
            at += len(own)
    assert sorted(map(tuple, placed.collect())) == want
    # No copy of a whole text goes with a run through a shuffle.
    assert "text" not in placed.columns and "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    wrong = spark.createDataFrame([(1, "abc", ["ab", "x", "longer"])], "doc_id long, text string, owns array<string>")
    assert [r["matches"] for r in intervals.cursor(wrong, F.col("own")).orderBy("n").collect()] == [True, False, False]

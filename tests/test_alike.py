"""Documents that say the same are worked on once, with the results of working on each."""

import pytest
from pyspark.sql import functions as F

from quire.operators import alike, decode, spans

TEXTS = ["关于推进工作的通知", "一、总体要求", "（二）重点任务", "各部门要认真落实各项任务，按时完成。", "公共服务管理办公室", "2024年3月5日", "", None, "名词解释", "时间：上午"]


def paragraphs(spark):
    rows = [(d, 10 * i + d, TEXTS[(d % 5 * 3 + i * i) % len(TEXTS)], "标题 1" if d % 5 == 1 and i == 2 else None) for d in range(15) for i in range(d % 5 + 2)]
    return spark.createDataFrame(rows + [(None, 1, TEXTS[1], None)], "doc_id long, pos int, text string, style string")


@pytest.mark.parametrize("frequent", [20_000, 2])
def test_classes_of_documents_decide_like_documents(spark, monkeypatch, frequent):
    monkeypatch.setattr(alike, "FREQUENT", frequent)
    df = paragraphs(spark)
    plain = decode.decided(decode.with_candidates(decode.features(df)))
    key = lambda r: (r[0] is None, *map(str, r))
    got = decode.decode(df)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_equal_documents_are_one_class(spark):
    read = []

    def facts(p, **more):
        read.append(p)
        return p.select("doc_id", "pos", F.length("text").alias("n"), *[c.alias(k) for k, c in more.items()])

    df = paragraphs(spark)
    found = alike.alike(df, facts)
    assert read[0].count() == df.select("text", "style").distinct().count()  # each text is read once
    assert found.docs.count() == 16 and found.classes.agg(F.sum("documents")).first()[0] == 16
    assert found.classes.count() == len({tuple(len(r[2]) if r[2] is not None else None for r in rows) for rows in by_document(df)})


def by_document(df):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.pos))
    return [[r for r in rows if r.doc_id == d] for d in {r.doc_id for r in rows}]


def test_equal_paragraphs_are_planned_once(spark, monkeypatch):
    kept, made = spans.stored, []
    monkeypatch.setattr(spans, "stored", lambda df: made.append(kept(df)) or made[-1])
    monkeypatch.setattr(alike, "FREQUENT", 1)
    texts = ["一、工作事项。各部门要落实各项工作。", "各部门要落实工作\n某某市财政局", " ", "2024年3月5日"]
    runs = "array(named_struct('start', 0, 'end', 4, 'bold', true, 'size', 14, 'font', '宋'))"
    df = spark.createDataFrame([(d, i, t) for d in range(12) for i, t in enumerate(texts)], "doc_id long, para int, text string").selectExpr("*", "doc_id % 2 = 0 as report", f"{runs} as runs")
    got = {(r.doc_id, r.para): (r.text, r.started, r.why, [tuple(x) for x in r.spans], r.visible == r.whole) for r in spans.plans(df).collect()}
    assert len(got) == 48 and made[-1].count() == 8  # four paragraphs, in reports and in others
    assert all(v == got[k[0] % 2, k[1]] and v[0] == texts[k[1]] and v[4] for k, v in got.items())
    assert [got[0, i][1:3] for i in range(4)] == [(False, "inline"), (True, "soft"), (True, "single"), (True, "single")]

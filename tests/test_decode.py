"""The beam over a document against enumeration of all paths and against a plain beam that keeps whole paths."""

import itertools
import random
from collections import namedtuple

from pyspark.sql import functions as F

from quire.functions import kernels as K
from quire.operators import context as C
from quire.operators import decode as D

Row = namedtuple("Row", "types costs softs before_body dispatch date colon note page metadata shape bold middle")
TYPES = ["title2", "glossary_title", "glossary_item", "main_title", "title_continuation", "dispatch_number", "heading_1", "heading_2", "heading_3", "body", "signature_date", "attachment_note", "meeting_meta"]


def document(rng, n):
    rows = []
    for _ in range(n):
        kinds = rng.sample(TYPES, rng.randint(1, 4))
        rows.append(Row(kinds, [-rng.randint(1, 20) / 20 for _ in kinds], [rng.random() > 0.1 for _ in kinds], rng.random() > 0.2, rng.random() < 0.1, rng.random() < 0.1, rng.choice(["none", "key_value", "body_label"]), rng.random() < 0.1, rng.random() < 0.1, rng.choice([None, None, "role_name"]), rng.choice([0, 1]), rng.random() < 0.5, rng.random() < 0.5))
    return rows


def open_glossary(names):
    """2 right behind a glossary's title or item, 1 after one more paragraph of body."""
    kinds = ("glossary_title", "glossary_item")
    return 2 if names and names[-1] in kinds else 1 if len(names) > 1 and names[-1] == "body" and names[-2] in kinds else 0


def allowed(row, names):
    fit = [i for i, k in enumerate(row.types) if not D.vetoed(k, row, names[-1] if names else None, "main_title" in names, open_glossary(names))]
    return [i for i in fit if not row.softs[i]] or fit


def gain(row, i, before, mode):
    return -row.costs[i] + D.transition(before, row.types[i], D.SECTION.get(before, "body") if before else None, mode) + D.between(row.types[i], row, before)


def test_a_wide_beam_finds_the_best_of_all_paths():
    rng = random.Random(1)
    met = 0
    for _ in range(800):
        rows, mode = document(rng, rng.randint(1, 5)), rng.choice(["unknown", "meeting_minutes"])
        best = None
        for choice in itertools.product(*(range(len(r.types)) for r in rows)):
            names = tuple(r.types[i] for r, i in zip(rows, choice))
            if all(i in allowed(r, names[:j]) for j, (r, i) in enumerate(zip(rows, choice))):
                score = sum(gain(r, i, names[j - 1] if j else None, mode) for j, (r, i) in enumerate(zip(rows, choice)))
                best = min(best or (9e9, ()), (round(-score, 9), names))
        if best is not None and all(not c for *_, c in D.beam(rows, mode, 10**6)):
            met += 1
            assert tuple(k for k, *_ in D.beam(rows, mode, 10**6)) == best[1]
    assert met > 200


def test_equals_a_beam_of_whole_paths():
    rng = random.Random(2)
    conflicts = 0
    for _ in range(300):
        rows = document(rng, rng.randint(1, 12))
        paths = [(0.0, (), ())]
        for r in rows:
            grown = [(cost - gain(r, i, names[-1] if names else None, "unknown"), (*names, r.types[i]), (*marks, False)) for cost, names, marks in paths for i in allowed(r, names)]
            paths = sorted(grown or [(cost, (*names, "body"), (*marks, True)) for cost, names, marks in paths], key=lambda p: (round(p[0], 9), p[1]))[: D.BEAM]
        got = D.beam(rows, "unknown")
        assert (tuple(k for k, *_ in got), tuple(c for *_, c in got)) == paths[0][1:]
        conflicts += any(paths[0][2])
    assert conflicts


def test_hard_candidates_are_never_cut(spark):
    rows = [(i, 0, text) for i, text in enumerate(["附件：1.方案", "各相关单位：", "2024年3月5日", "一、总体要求", "", None])]
    f = D.with_candidates(D.features(spark.createDataFrame(rows, "doc_id long, pos int, text string"))).collect()
    best = {r.doc_id: [(c.type, c.soft, -c.cost) for c in r.candidates if c.type not in D.DEPENDENT] for r in f}
    assert best[0][0] == ("attachment_note", False, 0.98) and best[1][0] == ("recipient", False, 0.95)
    assert best[2][0] == ("date_line", True, 0.97) and best[3][0][0] == "heading_1"
    assert best[4] == [("body", True, 0.45)] and best[5] == [("body", True, 0.45)]
    assert len({t for t, *_ in best[0]}) == len(best[0])


def test_modes(spark):
    texts = {1: ["", "某某会议纪要", "时间：九时", "地点：一楼"], 2: ["甲", "关于工作的报告", "某某会议记录"], 3: ["实施方案"] + ["甲"] * 9, 4: ["甲"] * 8 + ["关于工作的通知"], 5: [None, " "], 6: ["甲"] * 6 + ["关于工作的通知"]}
    rows = [(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)]
    got = {r.doc_id: (r["mode"], round(r.confidence, 9)) for r in D.detect_mode(spark.createDataFrame(rows, "doc_id long, pos int, text string")).collect()}
    assert got == {1: ("meeting_minutes", 0.84), 2: ("meeting_minutes", 0.72), 3: ("plan", 0.76), 4: ("unknown", 0.25), 5: ("unknown", 0.25), 6: ("notice", 0.69)}


def test_review_levels():
    assert D.review(0.95, None, 1.0, "body", False, 0) == (1.0, "confirmed", False)
    assert D.review(0.5, 0.0, 0.45, "main_title", False, 0) == (0.205, "review", False)
    assert D.review(0.9, 0.5, 0.7, "heading_1", False, 0)[1] == "critical_review"
    assert D.review(0.9, 0.5, 0.93, "heading_1", False, 0)[1] == "info"
    assert D.review(0.0, None, 0.45, "body", True, 0)[1] == "critical_review"


PLAIN = Row(["body"], [-0.5], [True], True, False, False, "none", False, False, None, 0, False, False)


def test_every_veto_and_transition():
    veto = lambda kind, before=None, titled=False, **facts: bool(D.vetoed(kind, PLAIN._replace(**facts), before, titled))
    assert not veto("main_title") and veto("main_title", titled=True) and veto("main_title", before_body=False) and veto("main_title", metadata="date_line")
    assert not veto("title_continuation", "main_title") and veto("title_continuation", "body") and veto("title_continuation", "main_title", date=True) and veto("title_continuation", "main_title", metadata="role_name")
    assert veto("title_continuation", "main_title", colon="recipient_candidate") and veto("title_continuation", "main_title", before_body=False)
    assert veto("body", dispatch=True) and not veto("dispatch_number", dispatch=True)
    for facts in ({"date": True}, {"note": True}, {"page": True}, {"colon": "body_label"}, {"colon": "key_value"}, {"colon": "explanatory_body"}):
        assert veto("heading_1", **facts) and not veto("body", **facts)
    assert veto("heading_3", "heading_1") and not veto("heading_2", "heading_1") and not veto("heading_1", "heading_4")
    assert veto("heading_1", "attachment_note", shape=1) and not veto("heading_1", "attachment_note") and veto("heading_2", "attachment_note_item", shape=2)
    assert veto("glossary_item") and not D.vetoed("glossary_item", PLAIN, "body", False, 1) and veto("glossary_title", "addressing") and not veto("glossary_title", "heading_1") and not veto("glossary_title", "main_title")
    assert veto("title2", "body", before_body=False) and not veto("title2", "body", before_body=False, middle=True) and veto("title2", "heading_1", before_body=False, middle=True)
    assert not veto("title2", "heading_1", before_body=False, bold=True) and not veto("title2", "main_title") and veto("title2", "signature_date", before_body=False, bold=True)
    assert D.between("title2", PLAIN._replace(middle=True), "body") == 0.10 and D.between("title2", PLAIN, "body") == D.between("body", PLAIN._replace(middle=True), "body") == 0.0
    cost = lambda before, kind, mode="unknown": D.transition(before, kind, D.SECTION.get(before, "body") if before else None, mode)
    assert cost("main_title", "title_continuation") == 0.18 and cost("title_continuation", "dispatch_number") == 0.30 and cost("heading_2", "meeting_meta") == 0.05
    assert cost("signature_date", "body") == -0.08 and cost("body", "main_title") == 0.0 and cost("body", "role_name") == -0.40 and cost("body", "dispatch_number") == -0.40
    assert cost("body", "meeting_meta", "meeting_minutes") == 0.04 and cost("body", "meeting_meta") == 0.0 and cost(None, "body") == 0.0


def test_the_context_reaches_the_beam(spark):
    texts = ["某某市人民政府", "关于开展专项工作的报告", "（2024年3月5日）", "市长  张某某", "各位代表：", "现在向大会报告工作，请予审议，并请各位提出意见。", "一、总体要求", "确保取得实效，完成各项目标任务。", "市长  张某某"]
    got = D.decode(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")).collect()
    assert [r.type for r in sorted(got, key=lambda r: r.pos)] == ["main_title", "title_continuation", "date_line", "role_name", "addressing", "body", "heading_1", "body", "body"]


def decoded(spark, texts):
    got = D.decode(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")).collect()
    return [r.type for r in sorted(got, key=lambda r: r.pos)]


def test_a_glossary_survives_one_paragraph(spark):
    body = "各部门要认真落实各项工作任务，按时完成。"
    head = ["关于工作的报告", "一、总体要求", body, "名词解释"]
    assert decoded(spark, [*head, "甲类：指第一种", body, "乙类：指第二种"])[3:] == ["glossary_title", "glossary_item", "body", "glossary_item"]
    assert decoded(spark, [*head, "甲类：指第一种", body, body, "乙类：指第二种"])[3:] == ["glossary_title", "glossary_item", "body", "body", "body"]
    assert decoded(spark, ["关于工作的报告", "一年来。", body]) == ["main_title", "heading_1", "body"]
    assert decoded(spark, ["关于工作的通知", "一年来。", body])[1] != "heading_1"
    assert decoded(spark, ["关于工作的报告", "一、总体要求", body, "几点体会", body])[3] == "title2"


def test_a_provider_changes_candidates_without_the_beam(spark, monkeypatch):
    monkeypatch.setitem(D.PROVIDERS, "poems", lambda: [D.propose(D.F.col("n") == 5, "verse", 0.99, "poems")])
    assert decoded(spark, ["床前明月光", "疑是地上霜", "一、总体要求"]) == ["verse", "verse", "heading_1"]


def test_a_style_decides_where_nothing_else_does(spark):
    rows = [(1, 0, "甲乙丙", "Heading 2"), (1, 1, "甲乙丙丁", "Normal"), (1, 2, "一、总体要求", "Heading 4"), (1, 3, "甲", None)]
    f = D.with_candidates(D.features(spark.createDataFrame(rows, "doc_id long, pos int, text string, style string"))).collect()
    own = {r.pos: {x.type: -x.cost for x in r.candidates if x.source == "style"} for r in f}
    assert own == {0: {"heading_2": 0.40}, 1: {}, 2: {"heading_4": 0.40}, 3: {}}  # body is proposed more strongly than by its style


def test_equal_documents_are_decoded_once(monkeypatch):
    facts = ['{"mode":"unknown","types":["body"],"costs":[-0.5],"softs":[true],"before_body":true,"shape":0,"siblings":0}'] * 3
    calls, own = [], D.beam
    monkeypatch.setattr(D, "beam", lambda *a: calls.append(a) or own(*a))
    D._KNOWN.clear()
    assert D._decided_once(facts) == D._decided_once(list(facts)) == D._decided([D._read(facts[0])[1]] * 3)
    assert len(calls) == 2  # once for both documents, once for the comparison
    assert len(D._decided_once(facts[:2])) == 2
    D._KNOWN.clear()
    D._decided_once(facts * D.LONGEST)
    assert not D._KNOWN  # long documents are not remembered


def test_texts_are_dealt_before_they_are_read(spark):
    one = spark.range(8).selectExpr("id % 4 as doc_id", "cast(id as int) as pos", "'一、总体要求' as text").coalesce(1)
    plan = D.features(one)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_roles_and_colons_by_faster_ways(spark):
    lines = ["", "市长", "县委书记兼", "主任、和", "长", "总经济师", "某总会计师，", "负责人及兼", "兼", "书记员", "代表和同志与", "同"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", C._ends_in_role(F.col("x")).alias("fast"), F.col("x").rlike(rf"(?:{C.ROLES})(?:[、，,/／&]|兼|及|和|与)*$").alias("plain")).collect()
    assert [r.x for r in got if r.fast != r.plain] == [] and any(r.fast for r in got)
    old = rf"(?:(?<!\p{{Nd}}{K._BLANK}{{0,64}})[:：]|[:：](?!{K._BLANK}*\p{{Nd}}))"
    texts = ["", "9:30", "9 : 30", "时间：9:30", "9：甲", "甲：9", ":9", "9:", "9 : ", "一:9:甲", "9:9:9：", " ： "]
    both = spark.createDataFrame([(x,) for x in texts], "x string").select("x", *[F.regexp_extract("x", f"(?s)^(.*?){p}", 0).alias(n) for n, p in (("fast", K._COLON), ("plain", old))]).collect()
    assert [r.x for r in both if r.fast != r.plain] == []

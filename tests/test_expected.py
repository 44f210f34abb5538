"""Expected values of queries and functions that SQL does not state: known results, enumeration, or another way to the same result."""

import hashlib
import itertools
import math
import os
import re
import unicodedata

from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.operators import decode, folds, normalization, reader
from quire.plans import catalogue

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")


def rows_of(spark, name):
    return catalogue.queries()[name](spark, DATA).collect()


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_normalized_text(spark):
    known = texts(spark)
    for r in rows_of(spark, "normalized_text"):
        t = re.sub("[ \t ]+", " ", unicodedata.normalize("NFKC", known[r["doc_id"]])).strip()
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["width"] == sum(0 if c == " " else 1 if unicodedata.east_asian_width(c) in "WFA" else 0.5 for c in known[r["doc_id"]])


def test_canonical_tape_and_its_runs(spark):
    known = texts(spark)
    for r in rows_of(spark, "canonical_tape"):
        text, out, maps, i = known[r["doc_id"]], "", [(0, 0, 0)], 0
        units = lambda s: sum(1 + (c > "￿") for c in s)
        while i < len(text):  # one character after another
            n = 2 if text[i : i + 2] == "\r\n" else 1
            c = text[i : i + n]
            new = "\n" if c in ("\r\n", "\r", "\v") else "" if c == "\x07" and i == len(text) - 1 else " " if c in " 　" else unicodedata.normalize("NFKC", c)
            out += new
            if not (len(c) == len(new) == 1 and c <= "￿" and new <= "￿"):
                maps.append((i + n, len(out), units(out)))
            i += n
        assert r["canonical_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert (r["raw_boundaries"], r["utf16"], r["runs"]) == (len(text) + 1, units(out), len(maps))
        assert r["runs_sha256"] == hashlib.sha256(";".join(",".join(map(str, m)) for m in maps).encode()).hexdigest()


def test_protected_spans_read_back(spark):
    known = texts(spark)
    for r in rows_of(spark, "protected_spans")[:2000]:
        piece = known[r["doc_id"]][r["start"] : r["end"]]
        assert piece and not piece[0].isspace() and not piece[-1].isspace()


def test_legacy_text_chain(spark):
    t = spark.createDataFrame([("一.要求.各部门,要落实:好;吗?对!",), ('他说"你好"和"再见"',), ("(中文)和(abc)",), ("3,5",), ("甲　乙​",), ("前文1;后",)], "t string")
    assert [r[0] for r in t.select(P.legacy_chain(F.col("t"))).collect()] == ["一.要求。各部门，要落实：好；吗？对！", "他说“你好”和“再见”", "（中文）和(abc)", "3,5", "甲乙", "前文1；后"]
    # Each derived line ends the same way, whatever stands before.
    got = rows_of(spark, "legacy_text_chain")
    assert got and all(r["text"].endswith("（中文）说“好”,可以？") for r in got)


def test_tail_by_all_short_sequences():
    kinds = ["body", "sign_org", "sign_date", "attachment_note", "attachment_note_item"]
    moved = 0
    for n in range(6):
        for types in itertools.product(kinds, repeat=n):
            order = folds.tail(list(types))
            assert sorted(order) == list(range(n))
            dates = [i for i, t in enumerate(types) if t == "sign_date"]
            notes = [i for i, t in enumerate(types) if t == "attachment_note" and dates and i > dates[-1]]
            orgs = [i for i, t in enumerate(types) if t == "sign_org" and dates and dates[-1] - 4 <= i < dates[-1]]
            if not (dates and notes and orgs):
                assert order == list(range(n))
                continue
            moved += 1
            org, date, note = orgs[-1], dates[-1], notes[0]
            items = list(itertools.takewhile(lambda i: i < n and types[i] == "attachment_note_item", range(note + 1, n + 1)))
            # The note, its items, the organization and the date stand together in this order; all others keep theirs.
            block = [note, *items, org, date]
            at = order.index(note)
            assert order[at : at + len(block)] == block
            assert [i for i in order if i not in block] == [i for i in range(n) if i not in block]
    assert moved > 50


def test_siblings_to_a_fixpoint():
    def naive(types, numbered):
        types, numbered, met = list(types), list(numbered), set()
        while (state := (tuple(types), tuple(numbered))) not in met:
            met.add(state)
            for i in range(len(types)):
                if types[i] not in normalization.PARENTS:
                    continue
                own = int(types[i][-1])
                stop = next((j for j in range(i + 1, len(types)) if types[j] in normalization.PARENTS and int(types[j][-1]) <= own), len(types))
                below = [j for j in range(i + 1, stop) if types[j].startswith("heading")]
                if len(below) >= 2 and len({types[j] for j in below}) == 1 and not any(numbered[j] for j in below):
                    for j in below:
                        types[j] = f"heading{min(own + 1, 4)}"
        return types

    kinds = ["body", "heading1", "heading2", "heading3", "heading4"]
    changed = 0
    for n in range(6):
        for types in itertools.product(kinds, repeat=n):
            got = normalization.merged(types, [False] * n)
            assert got == naive(types, [False] * n), types
            assert normalization.merged(got, [False] * n) == got  # stable
            changed += got != list(types)
    assert changed > 100
    assert normalization.merged(["heading1", "heading3", "heading3"], [False, True, False]) == ["heading1", "heading3", "heading3"]


def test_chain_and_guard(spark):
    rows = [("heading1", "一、"), ("heading1", "三、"), ("heading2", "（五）"), ("heading3", "7."), ("body", ""), ("sign_org", ""), ("sign_date", ""), ("attachment_note", ""), ("attachment_note_item", ""), ("attachment_page_mark", ""), ("heading1", "四、")]
    df = spark.createDataFrame([(1, i, t, n) for i, (t, n) in enumerate(rows)], "doc_id long, pos int, type string, number string")
    got = sorted(normalization.chain(df).collect(), key=lambda r: r["place"])
    assert [(r["pos"], r["number"]) for r in got] == [(0, "一、"), (1, "二、"), (2, "（一）"), (3, "1."), (4, ""), (7, ""), (8, ""), (5, ""), (6, ""), (9, ""), (10, "一、")]
    assert [(r["pos"], r["number"]) for r in sorted(normalization.chain(df, "strict").collect(), key=lambda r: r["place"])] == [(i, n) for i, (_, n) in enumerate(rows)]
    assert normalization.guard(df, normalization.chain(df)).count() == 0
    wrong = df.withColumn("type", F.when(F.col("pos") == 3, "heading2").otherwise(F.col("type"))).where("pos <> 4")
    assert sorted((r["pos"], r["was"], r["now"]) for r in normalization.guard(df, wrong).collect()) == [(3, "heading3", "heading2"), (4, "body", None)]


def test_sibling_merge_moves_only_uniform_ones(spark):
    for r in rows_of(spark, "sibling_merge"):
        assert r["type"].startswith("heading") and r["merged"].startswith("heading") and r["type"] != r["merged"]


LINES = ["关于推进公共服务工作的通知", "内政发〔2026〕12号", "各相关单位：", "现将有关事项说明如下，请各单位结合实际认真贯彻落实。", "一、总体要求", "图1 结构", "附件：1.方案", "公共服务管理办公室", "2026年3月5日"]


def test_strongest_candidates(spark):
    f = decode.with_candidates(decode.features(spark.createDataFrame([(1, i, t) for i, t in enumerate(LINES)], "doc_id long, pos int, text string")))
    got = {r["pos"]: r for r in f.select("pos", F.get(decode.free(), F.lit(0)).alias("c")).select("pos", "c.*").collect()}
    assert [(got[i]["type"], round(-got[i]["cost"], 9), got[i]["source"], not got[i]["soft"]) for i in range(len(LINES))] == [
        ("main_title", 0.99, "semantic", False), ("dispatch_number", 1.0, "structural", True), ("recipient", 0.95, "structural", True), ("body", 0.82, "prose", False), ("heading_1", 0.8, "numbering", False),
        ("caption", 1.0, "structural", True), ("attachment_note", 0.98, "structural", True), ("signature_org", 0.97, "structural", True), ("signature_date", 0.97, "structural", True),
    ]


def test_candidate_quality_and_softmax_from_the_candidates(spark):
    f = decode.with_candidates(decode.features(decode.documents(spark, DATA))).select("doc_id", "pos", decode.free().alias("candidates")).collect()
    margins = {(r["doc_id"], r["pos"]): r for r in rows_of(spark, "candidate_softmax_margin")}
    by_size: dict = {}
    for r in f:
        score = [-c["cost"] for c in r["candidates"]]
        sure = 1 / sum(math.exp(s - max(score)) for s in score)
        best = min((c["cost"], c["type"]) for c in r["candidates"])
        other = [-c["cost"] for c in r["candidates"] if c["type"] != best[1]]
        m = margins[r["doc_id"], r["pos"]]
        assert (m["type"], m["best"]) == (best[1], -best[0]) and abs(m["confidence"] - sure) < 1e-9
        assert m["margin"] is None if not other else abs(m["margin"] - (-best[0] - max(other))) < 1e-9
        by_size.setdefault(len(score), []).append((any(not c["soft"] for c in r["candidates"]), sure))
    got = {r["candidates"]: r for r in rows_of(spark, "candidate_quality")}
    assert set(got) == set(by_size)
    for n, own in by_size.items():
        assert (got[n]["paragraphs"], got[n]["with_hard"]) == (len(own), sum(h for h, _ in own)) and abs(got[n]["softmax"] - sum(s for _, s in own) / len(own)) < 0.00051


def test_single_line_predicates(spark):
    def of(function, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r["x"] for r in df.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]

    assert of(P.strict_date, "2024年3月5日", " 2024 年 3 月 5 日 ", "二〇二四年三月五日", "1899年1月1日") == [True, True, False, False]
    assert of(P.signature_org, "某某市财政局", "请财政局", "某某市财政局。", "局", "关于" + "很" * 30 + "局") == [True, False, False, False, False]
    assert of(P.document_title, "关于工作的通知", "通知", "关于：通知", "工作安排") == [True, False, False, False]
    assert of(P.object_caption, "图1 结构", "表 2", "图片") == [True, True, False]
    assert of(P.is_attachment_item, "1.方案", "2、清单", "附件", "3 方案") == [True, True, False, False]
    assert of(P.body_like_candidate, "各部门要认真落实各项工作。", "短。", "很" * 34, "很" * 33) == [True, False, True, False]
    assert of(P.visible_length, "a b​c　", "") == [3, 0] and of(P.utf16_length, "a😀", "") == [3, 0]
    assert of(P.column_count, "姓名\t职务", "甲  乙  丙", "一句话。又一句。\t乙", "单列") == [2, 3, 0, 0]
    assert of(P.numbered_lead, "比如：一是", "首先一是二是", "没有") == [0, 2, -1]
    assert of(P.damaged_heading, "一 总体要求", "）二具体", "（三具体", "一、总体要求", "一总体要求", "正文") == [True, True, True, True, False, False]
    assert of(lambda c: P.body_like_context(c, F.lit(False)), "一、各部门要认真落实各项工作。", "各部门要认真落实各项工作。", "很" * 40) == [False, True, False]
    assert of(P.ends_with_punctuation, "好。", "好.", "好 ", "好") == [True, True, False, False]


def test_imports_beyond_the_limit(spark):
    f = spark.createDataFrame([(1, "a.txt", bytearray(b"abc")), (2, "a.txt", bytearray(b"abcd")), (3, "a.md", bytearray(b"abcdef")), (4, "a.TXT", bytearray(b""))], "doc_id long, name string, raw binary")
    assert {r["doc_id"]: r["reason"] for r in reader.imports(f, 3).collect()} == {1: None, 2: "READER_FILE_TOO_LARGE", 3: "READER_FILE_TYPE_UNSUPPORTED", 4: "READER_FILE_EMPTY"}


def test_alignment_queries_keep_their_laws(spark):
    lines = {(d, i) for d, t in texts(spark).items() for i, x in enumerate(t.split("\n")) if x.strip(" ")}
    found = {(r["doc_id"], r["pos"]): r for r in rows_of(spark, "alignment_lcs")}
    assert set(found) == lines
    assert all(r["candidates"] == 0 or r["status"] != "unmatched" for r in found.values())
    # A host line of its own is bound; what the host lost is bound to nothing or to an equal line.
    assert sum(r["status"] == "matched_unique" for r in found.values()) > len(lines) / 3
    for r in rows_of(spark, "binding_decisions"):
        status = found[r["doc_id"], r["pos"]]["status"]
        assert (r["binding"], r["warning"]) == {"matched_unique": ("confirmed", None), "matched_review": ("review", "RAW_TEXT_NORMALIZED"), "ambiguous": ("unresolved", "SOURCE_OCCURRENCE_AMBIGUOUS"), "unmatched": ("unresolved", "PHYSICAL_PARAGRAPH_UNMATCHED")}[status]




def test_recognition_summary_counts_the_decisions(spark):
    docs = decode.documents(spark, DATA).where("doc_id % 5 = 0")
    found = {}
    for r in decode.decode(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    candidates = {}
    for r in decode.with_candidates(decode.features(docs)).select("doc_id", "mode", "candidates").collect():
        candidates.setdefault(r["doc_id"], []).append(r)
    got = {r["doc_id"]: r for r in decode.summary(docs).collect()}
    assert set(got) == set(found)
    for d, rows in found.items():
        own, sizes = candidates[d], [len(r["candidates"]) for r in candidates[d]]
        assert (got[d]["mode"], got[d]["paragraphs"], got[d]["candidates"], got[d]["most_candidates"]) == (own[0]["mode"], len(rows), sum(sizes), max(sizes))
        assert (got[d]["single"], got[d]["double"], got[d]["more"]) == (sizes.count(1), sizes.count(2), sum(n > 2 for n in sizes))
        assert got[d]["with_hard"] == sum(any(not c["soft"] for c in r["candidates"]) for r in own)
        levels = [r["level"] for r in rows]
        assert [got[d][x] for x in ("confirmed", "info", "review", "critical_review")] == [levels.count(x) for x in ("confirmed", "info", "review", "critical_review")]
        assert got[d]["needs_review"] == got[d]["review"] + got[d]["critical_review"] and got[d]["low_confidence"] == sum(r["confidence"] < 0.6 for r in rows)
        assert (got[d]["conflicts"], got[d]["headings"], got[d]["types"]) == (sum(r["conflict"] for r in rows), sum(r["type"].startswith("heading_") for r in rows), len({r["type"] for r in rows}))

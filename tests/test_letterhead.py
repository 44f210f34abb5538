"""Letterheads: every short head of a small alphabet against rules on strings, and known heads with their fields."""

import itertools
import re
from collections import namedtuple

from quire.operators import letterhead as L

Block = namedtuple("Block", "doc_id at paragraph text c style managed drawing blank number signer red_mark file_mark agency metadata separator star follows caption prominent")
SHAPES = {
    "M": {"text": "某某市人民政府文件", "red_mark": True, "file_mark": True}, "N": {"text": "某政发〔2024〕3号", "number": "standard"}, "C": {"text": "某政发[2024]3号", "number": "compatible"}, "P": {"separator": True, "blank": True},
    "B": {"blank": True}, "T": {"text": "关于工作的通知"}, "X": {"text": "各部门要落实。"}, "D": {"text": "特急", "metadata": True},
}


def head(letters):
    rows = []
    for i, x in enumerate(letters):
        own = {"text": "", "number": None, **dict.fromkeys(Block._fields[7:9] + Block._fields[10:], False), **SHAPES[x]}
        rows.append(Block(doc_id=1, at=i, paragraph=True, c=own["text"], style="", managed=False, **own))
    return rows


def by_strings(s):
    """The same decision, told by expressions over the letters; separators are blank lines to whatever looks for text."""
    # A mark counts where a signal stands behind blank lines, or up to three lines behind it, signals and blank ones aside, end as a title.
    live = [bool(x == "M" and (re.match("B*[NCP]", s[i + 1 :]) or re.match("[BNCP]*(?:[MD][BNCP]*){0,2}T", s[i + 1 :]))) for i, x in enumerate(s)]
    signal = [x in "NCPD" or on for x, on in zip(s, live)]
    start = next((i for i, x in enumerate(s) if x not in "BP"), None)
    if start is None or not signal[start]:
        return "none"
    stop = next((i for i in range(start, len(s)) if not signal[i] and s[i] != "B"), len(s))
    lead = "".join(x for i, x in enumerate(s[:stop]) if i >= start and x != "B")
    kinds = set(lead.replace("C", "N"))
    if re.match("[^N]*M.*N", lead) or re.search("N.*P", lead):
        return "recognized"
    partial = kinds & set("MN") and (kinds == {"M"} or kinds <= set("DN"))
    return "unknown" if partial or "C" in lead or len(kinds) > 1 else "none"


def test_every_short_head():
    seen = {}
    for n in range(1, 6):
        for letters in itertools.product("MNCPBTXD", repeat=n):
            status, protected, why = L.detect(head(letters))
            assert status == by_strings("".join(letters)), (letters, status, why)
            seen[status] = seen.get(status, 0) + 1
            if status != "none":
                # What is protected is a prefix that ends before any ordinary paragraph.
                assert protected == list(range(len(protected))) and not {letters[i] for i in protected} & {"X", "T"}
                assert len(protected) == n or letters[len(protected)] != "B"
    assert min(seen.values()) > 1000, seen


def documents(spark, heads):
    rows = []
    for d, blocks in enumerate(heads):
        for i, b in enumerate(blocks):
            own = b if isinstance(b, dict) else {"text": b}
            rows.append((d, i, own.get("paragraph", True), own.get("text"), own.get("color"), own.get("alignment"), own.get("size"), own.get("border", False), own.get("star", False), own.get("drawing", False), own.get("style"), own.get("managed", False)))
    schema = "doc_id long, pos long, paragraph boolean, text string, color string, alignment string, size int, border boolean, star boolean, drawing boolean, style string, managed boolean"
    return {r["doc_id"]: r for r in L.letterheads(spark.createDataFrame(rows, schema)).collect()}


def test_known_heads_and_their_fields(spark):
    mark, line, star = {"text": "某某市人民政府文件", "color": "#e02020"}, {"border": True}, {"star": True}
    got = documents(spark, [
        ["特急", mark, "", "某政发〔2024〕15号签发人：张三", line, "", "关于工作的通知"],
        ["某某市财政局", mark, "某政发〔2024〕15号", "签发人：张三", "李 四", star, "关于工作的通知"],
        [mark, "关于工作的通知"], ["某政发[2024]第3号", "关于工作的通知"], [{"drawing": True}, "图1 地图"], [{"drawing": True}, "某政发〔2024〕15号", "正文。"], ["正文。", mark, "某政发〔2024〕15号"],
        [{"text": "市委", "style": "DCT-LetterheadMark", "managed": True}, {"text": "市委〔2023〕7号", "style": "DCT-DocumentNumber"}, {"style": "DCT-LetterheadSeparator"}, "正文。"],
        [mark, "某政发〔2024〕15号", "某政发〔2024〕16号", line], [None, ""], [{"text": "某某市教育局", "color": "FF0000", "alignment": "center", "size": 30}, "某教〔2024〕2号", line], [*[""] * 40, mark, "某政发〔2024〕15号"],
    ])
    assert [(got[i]["status"], got[i]["first"], got[i]["last"], got[i]["reason"]) for i in range(12)] == [
        ("recognized", 0, 5, "red-mark"), ("recognized", 0, 5, "red-mark"), ("unknown", 0, 0, "incomplete-mark"), ("unknown", 0, 0, "compatible-number"), ("none", None, None, None), ("unknown", 0, 1, "drawing"), ("none", None, None, None),
        ("managed", 0, 2, "styles"), ("recognized", 0, 3, "red-mark"), ("none", None, None, None), ("recognized", 0, 2, "red-mark"), ("none", None, None, None),
    ]
    of = lambda i: tuple(got[i])[5:]
    assert of(0) == ("某某市人民政府文件", "某政发", 2024, 15, "张三", "straight", "single")
    assert of(1) == ("某某市财政局", "某政发", 2024, 15, "张三、李四", "star", "joint")
    assert of(7) == ("市委", "市委", 2023, 7, None, "straight", "single") and of(10)[:4] == ("某某市教育局", "某教", 2024, 2)
    assert of(8) == (None,) * 7  # two numbers


def test_red(spark):
    values = {"FF0000": True, "#C83232": True, "960000": True, "800000": False, "FF8080": True, "FFC0C0": True, "FFD0D0": False, "auto": False, None: False}
    rows = spark.createDataFrame([(k,) for k in values], "c string")
    assert {r["c"]: r["x"] for r in rows.select("c", L.red(rows.c).alias("x")).collect()} == values

"""Shape predicates and small text functions over paragraphs, as column expressions.

Patterns state Unicode classes explicitly, because Java's \\s and \\d are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s 　 -      \u0085]"
CN = "一二三四五六七八九十百"
# Lexicons of the shape rules.
TITLE_SUFFIXES = ("通知", "报告", "请示", "方案", "意见", "决定", "公告", "通报", "纪要", "办法", "规定", "函")
ORG_SUFFIXES = ("委员会", "办公室", "人民政府", "管理局", "研究院", "中心", "公司", "学院", "大学", "医院", "部", "厅", "局", "处", "科", "所", "院", "会")
NEGATIVE_STARTS = ("以上", "请", "现将", "特此", "根据", "为了", "按照")


def strip(text: Column) -> Column:
    """Remove white space of any script at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def compact(text: Column) -> Column:
    """Remove all white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def visible_length(text: Column) -> Column:
    """Characters that are neither white space nor zero-width."""
    return F.length(F.regexp_replace(text, r"[\s 　 -‏ -  ⁠﻿ \u0085]", ""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def dispatch_parts(text: Column) -> Column:
    """struct(issuer, year, number) of a dispatch number on compact text, else NULL."""
    t = compact(text)
    pattern = r"^([一-鿿A-Za-z0-9]{0,16})[〔\[]([0-9]{4})[〕\]]([0-9]+)号$"
    return F.when(t.rlike(pattern), F.struct(*[F.regexp_extract(t, pattern, i).alias(n) for i, n in enumerate(("issuer", "year", "number"), 1)]))


def heading_level(text: Column) -> Column:
    """1..4 by the shape of the leading number; a level-4 shape with a colon is none."""
    colon = text.rlike("[:：]")
    return (
        F.when(text.rlike(f"^[{CN}]+[、.．]"), 1)
        .when(text.rlike(f"^[（(][{CN}]+[）)]"), 2)
        .when(text.rlike("^[0-9]+[.．]"), 3)
        .when(text.rlike("^[（(][0-9]+[）)]") & ~colon, 4)
    )


def heading_prefix(text: Column) -> Column:
    """The leading number of a heading, empty if there is none."""
    return F.regexp_extract(text, rf"^([{CN}]+[、.．]+|[（(][{CN}]+[）)]|[0-9]+[.．]|[（(][0-9]+[）)])", 1)


def strict_date(text: Column) -> Column:
    return compact(text).rlike("^(19|20)[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日$")


def sign_date_pattern() -> str:
    y, n = "(?:19|20)[0-9]{2}|[零〇○一二两三四五六七八九]{4}", "[0-9]{1,2}|[零〇一二两三四五六七八九十]{1,3}"
    return rf"^\s*({y})\s*年\s*({n})\s*月\s*({n})\s*日\s*$"


def normalize_sign_date(text: Column) -> Column:
    """Year, month and day in Arabic digits; other text, and dates with a zero part, are unchanged."""
    from .numerals import date_number

    p = sign_date_pattern()
    year = F.translate(F.regexp_extract(text, p, 1), "零〇○一二两三四五六七八九", "000122" + "3456789")
    month, day = (date_number(F.regexp_extract(text, p, i)) for i in (2, 3))
    return F.when(text.rlike(p) & (month > 0) & (day > 0), F.concat(year, F.lit("年"), month.cast("string"), F.lit("月"), day.cast("string"), F.lit("日"))).otherwise(text)


def attachment_mark(text: Column) -> Column:
    """附件 N, or 附件; other text is unchanged."""
    from .numerals import date_number

    p = r"^\s*附件\s*([0-9一二三四五六七八九十百千]*)\s*$"
    n = date_number(F.regexp_extract(text, p, 1))
    return F.when(text.rlike(p), F.concat(F.lit("附件"), F.when(n.isNotNull(), F.concat(F.lit(" "), n.cast("string"))).otherwise(""))).otherwise(text)


def is_attachment_note(text: Column) -> Column:
    return text.rlike("^附件[:：].*")


def is_attachment_item(text: Column) -> Column:
    return text.rlike(r"^[0-9]+[.．、]\s*\S+")


def organization_label(text: Column) -> Column:
    return F.regexp_replace(strip(text), "[:：]$", "").rlike("(" + "|".join(ORG_SUFFIXES) + ")$")


def signature_org(text: Column, most: int = 30) -> Column:
    """A short line that ends like an organization and neither argues nor addresses."""
    t = strip(text)
    return F.length(t).between(2, most) & organization_label(t) & ~t.rlike("^(" + "|".join(NEGATIVE_STARTS) + ")") & ~t.rlike("[。；;：:]")


def document_title(text: Column) -> Column:
    t = strip(text)
    return F.length(t).between(4, 60) & t.rlike("(" + "|".join(TITLE_SUFFIXES) + ")$") & ~t.rlike("[。；：:，,]")


def object_caption(text: Column) -> Column:
    return compact(text).rlike("^[图表][0-9]+")


def damaged_heading(text: Column) -> Column:
    """A heading whose number lost its mark: at most 30 characters, no sentence mark near the start."""
    t = strip(text)
    shape = t.rlike(rf"^[{CN}]+[，,、\s]") | t.rlike(f"^[）)][{CN}]+") | (t.rlike(rf"^[（(][{CN}]+") & (F.length(t) <= 15))
    return (F.length(t) <= 30) & ~F.substring(t, 1, 10).rlike("[。；：]") & shape


def numbered_lead(text: Column) -> Column:
    """Place of the first 一是 / 一要 style lead, from 0; -1 without one."""
    return F.when(text.startswith("比如："), 0).otherwise(F.regexp_instr(text, F.lit("[一二三四五六七八九十]+(?:是|要)")) - 1)


def body_like_context(text: Column, centred: Column) -> Column:
    sentence = text.rlike("[。！？；]")
    n = F.length(strip(text))
    return F.when(heading_level(text).isNotNull(), False).otherwise((sentence & ~centred & (n >= 12)) | ((n >= 34) & sentence))


def body_like_candidate(text: Column) -> Column:
    """Unlike in context, 34 characters suffice without a sentence mark."""
    n = F.length(strip(text))
    return (text.rlike("[。！？；]") & (n >= 12)) | (n >= 34)


def ends_with_punctuation(text: Column) -> Column:
    return text.rlike(r"\p{P}\s*$")


def column_count(text: Column) -> Column:
    """Columns of a table typed with tabs or wide gaps; 0 where the line is no such row."""
    parts = F.filter(F.transform(F.split(text, r"\t+| {2,}|　+"), strip), lambda c: c != "")
    fine = (F.size(parts) >= 2) & F.forall(parts, lambda c: F.length(c) <= 24) & (F.length(text) - F.length(F.regexp_replace(text, "[。；！？]", "")) <= 1)
    return F.when(fine, F.size(parts)).otherwise(0)


def basic_text(text: Column) -> Column:
    """Full-width parentheses around Chinese; zero-width and wide spaces go."""
    out = F.regexp_replace(text, r"\(([^()]*[一-鿿][^()]*)\)", "（$1）")
    return F.regexp_replace(out, "[​　 ]", "")


def chinese_punctuation(text: Column) -> Column:
    """Half-width marks after Chinese become full-width; a full stop stays after a leading Chinese number."""
    out = text
    for half, wide, before in ((":", "：", ""), (",", "，", ""), (";", "；", "0-9"), (r"\?", "？", ""), ("!", "！", "")):
        out = F.regexp_replace(out, rf"(?<=[一-鿿{before}]){half}", wide)
    lead = r"^[一二三四五六七八九十]{1,5}\."
    dots = F.regexp_replace(out, r"(?<=[一-鿿])\.", "。")
    return F.when(out.rlike(lead), F.concat(F.regexp_extract(out, lead, 0), F.regexp_replace(F.regexp_replace(out, lead, ""), r"(?<=[一-鿿])\.", "。"))).otherwise(dots)


def quotes(text: Column) -> Column:
    """Straight double quotes alternate between opening and closing ones."""
    parts = F.split(text, '"', -1)
    pieces = F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "“").otherwise("”"), p))
    return F.array_join(pieces, "")


def legacy_chain(text: Column) -> Column:
    return chinese_punctuation(quotes(basic_text(text)))


def file_name(name: Column) -> Column:
    """A safe file name: path marks and control characters become underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"[\\/:*?\"<>|\x00-\x1f]", "_"), r"^\.+", "")


def redacted(line: Column) -> Column:
    """Log lines without addresses of mail and of hosts."""
    out = F.regexp_replace(line, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[mail]")
    return F.regexp_replace(out, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[host]")

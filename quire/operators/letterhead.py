"""Letterheads in the first blocks of a document: managed, recognised, unclear or none, what they protect, and their fields.

What a block can be is a set of column expressions; only the first ``TOP`` blocks of a document are sorted and walked, whatever
its length. A walk needs no text but what a title, a number or a signer says.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.operators.grouped import per_document
from quire.plans.registry import query
from quire.sources.tables import table

TOP, REACH, JOINT, TITLE_PARTS = 32, 12, 8, 3
# Forms of the lines of a letterhead.
_CODE, _SIGNER = r"[^\s，。；：:（）()《》“”]{1,24}", "签发人[：:].{1,80}"
STANDARD = rf"^({_CODE})〔([0-9]{{4}})〕([0-9]+)号({_SIGNER})?$"
COMPATIBLE = r"^[^\s，。；：:（）()《》“”\[\]【】〔〕]{1,24}(?:\[[0-9]{4}\]|【[0-9]{4}】|（[0-9]{4}）|\([0-9]{4}\)|〔[0-9]{4}〕)第?[0-9]+号(?:" + _SIGNER + ")?$"
_AGENCY = "(?!关于).{2,36}(?:委员会|人民政府|办公室|办公厅|党组|党委|委|办|局|厅|部|院|中心)"
METADATA = "^(?:[0-9]{6}|(?:绝密|机密|秘密)(?:★[0-9]+(?:年|月|日)?)?|特提|特急|加急|平急)$"
TITLE_ENDS = ("决议", "决定", "命令", "令", "公报", "公告", "通告", "意见", "通知", "通报", "报告", "请示", "批复", "议案", "函", "纪要", "方案", "总结", "要点", "安排", "计划", "细则", "办法", "规定")
MANAGED = ("DCT-LetterheadSpacer", "DCT-LetterheadMark", "DCT-DocumentNumber", "DCT-SignerLine", "DCT-LetterheadSeparator")


def red(color: Column) -> Column:
    """Whether a colour of six hex digits is clearly red."""
    c = F.upper(F.regexp_replace(F.trim(F.coalesce(color, F.lit(""))), "^#+", ""))
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    return F.when(c.rlike("^[0-9A-F]{6}$"), (part(1) >= 150) & (part(1) - part(3) >= 55) & (part(1) - part(5) >= 55)).otherwise(False)


def block_facts(blocks: DataFrame) -> DataFrame:
    """What each of the first blocks (doc_id, pos, paragraph, text, color, alignment, size, border, star, drawing, style, managed) of a document can be."""
    first = blocks.withColumn("at", (F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1).cast("int")).where(F.col("at") < TOP)
    text = F.when(F.col("paragraph"), P.strip(F.coalesce("text", F.lit("")))).otherwise("")
    df = first.withColumn("text", text).withColumn("c", P.compact(F.col("text"))).withColumn("red", F.col("paragraph") & red(F.col("color")))
    c, n = F.col("c"), F.length("c")
    standard, signed = c.rlike(STANDARD), c.rlike(f"^{_SIGNER}$")
    number = F.when(standard, "standard").when(c.rlike(COMPATIBLE), "compatible")
    agency = c.rlike(f"^{_AGENCY}$")
    red_mark = F.col("red") & n.between(1, 80) & F.when(c.contains("文件"), ~c.startswith("关于") & (n >= 4)).otherwise(n.between(4, 40) & F.coalesce("alignment", F.lit("")).isin("center", "both", "distribute") & (F.col("size") >= 26))
    star = F.col("star") | c.contains("★")
    signer = signed | (number.isNotNull() & c.contains("签发人"))
    follows = n.between(2, 24) & F.col("text").rlike(r"^[㐀-鿿·\s　]+$") & ~c.startswith("关于") & ~c.rlike("(?:" + "|".join(TITLE_ENDS) + ")$") & ~agency
    return df.select(
        "doc_id", "at", "paragraph", "text", "c", F.coalesce("style", F.lit("")).alias("style"), "managed", "drawing", (F.col("paragraph") & (F.col("text") == "") & ~F.col("drawing")).alias("blank"), number.alias("number"), signer.alias("signer"), F.coalesce(red_mark, F.lit(False)).alias("red_mark"),
        c.rlike(f"^{_AGENCY}文件$").alias("file_mark"), agency.alias("agency"), c.rlike(METADATA).alias("metadata"), (F.col("paragraph") & (F.col("border") | star) & ((c == "") | number.isNotNull() | signer)).alias("separator"), star.alias("star"), follows.alias("follows"),
        F.col("text").rlike("^(?:表|图)\\s*[0-9一二三四五六七八九十百]+").alias("caption"), (F.lower("style").contains("title") | F.coalesce("style", F.lit("")).contains("标题") | (F.coalesce("alignment", F.lit("")) == "center") | (F.coalesce("size", F.lit(0)) >= 18)).alias("prominent"),
    )


def titled(rows: list, at: int, signals: set[int]) -> bool:
    """Whether a title follows a mark: up to three paragraphs behind it, past signals and blank lines."""
    parts, lead = "", None
    for r, left in zip((x for x in rows[at + 1 : at + 1 + REACH] if x.at not in signals and not x.blank), range(TITLE_PARTS)):
        if not r.paragraph or r.drawing:
            return False
        lead = lead or r
        parts = re.sub(r"\s+", "", parts + r.text)
        if 4 <= len(parts) <= 120 and not re.search("[：:]$|[。！？；;]", parts) and (parts.startswith("关于") or parts.endswith(TITLE_ENDS) or lead.prominent):
            return True
        if re.search("[。！？；;：:]", parts):
            return False
    return False


def signals_of(rows: list) -> dict[int, set[str]]:
    """The kinds of each block that can belong to a letterhead; a mark counts if a signal or a title follows it, agencies above a mark count with it."""
    out: dict[int, set[str]] = {}
    tell = lambda at, kind: out.setdefault(at, set()).add(kind)
    for r in rows:
        for kind, holds in (("number", r.number), ("separator", r.separator)):
            if holds:
                tell(r.at, kind)
    for r in rows:
        if not r.signer:
            continue
        tell(r.at, "signer")
        for x in rows[r.at + 1 :]:
            if "separator" in out.get(x.at, ()):
                break
            if x.blank:
                continue
            if not x.paragraph or not x.follows:
                break
            tell(x.at, "signer")
    header = set(out)
    for r in rows:
        if not (r.red_mark or r.file_mark):
            continue
        behind = next((x.at for x in rows[r.at + 1 : r.at + 1 + REACH] if x.at in header or not x.blank), None)
        if behind in header or titled(rows, r.at, header):
            tell(r.at, "mark")
    for at in [i for i, kinds in out.items() if "mark" in kinds]:
        for x in reversed(rows[max(0, at - JOINT) : at]):
            if x.blank:
                continue
            if not x.paragraph or not x.agency:
                break
            tell(x.at, "mark")
    for r in rows:
        if r.metadata:
            tell(r.at, "metadata")
    first = next((r for r in rows if not r.blank), None)
    if first is not None and first.drawing and not (first.at + 1 < len(rows) and rows[first.at + 1].caption):
        tell(first.at, "drawing")
    return out


def detect(rows: list) -> tuple[str, list[int], str]:
    """(status, protected places, why) of the first blocks of a document."""
    styles = [r.style if r.paragraph else "" for r in rows]
    begin = next((i for i, s in enumerate(styles) if s in MANAGED[:2]), None)
    if begin is not None and rows[0].managed and MANAGED[-1] in styles[begin:]:
        end = styles.index(MANAGED[-1], begin)
        if MANAGED[2] in styles[begin : end + 1] and set(styles[begin : end + 1]) <= set(MANAGED):
            return "managed", list(range(begin, end + 1)), "styles"
    found = signals_of(rows)
    first = next((r.at for r in rows if not r.blank), None)
    if first not in found:
        return "none", [], ""
    # The leading stretch of signals; an ordinary paragraph ends it, blank ones do not.
    places = []
    for r in rows[first:]:
        if r.at in found:
            places.append(r.at)
        elif not r.blank:
            break
    having = lambda kind: [i for i in places if kind in found[i]]
    kinds = set().union(*(found[i] for i in places))
    numbers, signers, separators = having("number"), having("signer"), having("separator")
    standard = [i for i in numbers if rows[i].number == "standard"]
    compatible = [i for i in numbers if rows[i].number == "compatible"]
    marks = [i for i in places if rows[i].red_mark]
    visual = bool(marks and standard and min(marks) <= min(standard))
    known = visual or bool(standard and separators and min(standard) <= max(separators))
    partial = bool(kinds & {"mark", "number"}) and (kinds == {"mark"} or kinds <= {"metadata", "number", "signer"})
    drawn = bool(having("drawing"))
    unclear = partial or bool(compatible) or (drawn and len(kinds) > 1) or (len(kinds) > 1 and kinds != {"number", "signer"} and not known)
    if not known and not unclear:
        return "none", [], ""
    last = max(places)
    if known:
        told = max(numbers + signers)
        last = next((i for i in separators if i >= told), told)
    while last + 1 < len(rows) and rows[last + 1].blank:
        last += 1
    # Everything before the first visible block is blank.
    protected = list(range(0, last + 1))
    if known:
        return "recognized", protected, "red-mark" if visual else "separator"
    why = "compatible-number" if compatible else "incomplete-number" if partial and kinds <= {"metadata", "number"} else "incomplete-mark" if partial and kinds == {"mark"} else "incomplete-signer" if partial else "drawing" if drawn else "ambiguous"
    return "unknown", protected, why


def fields(rows: list, protected: list[int]) -> tuple | None:
    """(mark, with 文件, agency code, year, sequence, signers, separator, issuance) of a managed or recognised head; None where a field is missing or a number stands twice."""
    own = [rows[i] for i in protected if rows[i].paragraph]
    marks = [r.c for r in own if r.c and (r.style == MANAGED[1] or r.red_mark or r.file_mark or r.agency)]
    numbers = [m for r in own if (m := re.match(STANDARD, r.c))]
    if not marks or marks[0] == "文件" or len(numbers) != 1:
        return None
    signers: list[str] = []
    for r in own:
        m = re.match(STANDARD, r.c)
        if m or re.match(f"^{_SIGNER}$", r.c):
            signers += [s for s in re.split("签发人[：:]", (m[4] or "") if m else r.c) if s]
        elif r.c and signers and r.follows:
            signers.append(r.c)
    code, year, sequence = numbers[0].group(1, 2, 3)
    return marks[0], marks[0].endswith("文件"), code, int(year), int(sequence), signers, "star" if any(r.star for r in own) else "straight", "joint" if len(marks) > 1 else "single"


def letterheads(blocks: DataFrame) -> DataFrame:
    """(doc_id, status, first, last, reason, mark, code, year, sequence, signers, separator, issuance) of every document."""

    def run(rows: list) -> list[tuple]:
        status, protected, why = detect(rows)
        known = fields(rows, protected) if status in ("managed", "recognized") else None
        mark, _, code, year, sequence, signers, separator, issuance = known or (None,) * 8
        return [(rows[0].doc_id, status, min(protected, default=None), max(protected, default=None), why or None, mark, code, year, sequence, "、".join(signers) if signers else None, separator, issuance)]

    return per_document(block_facts(blocks), run, "doc_id bigint, status string, first int, last int, reason string, mark string, code string, year int, sequence int, signers string, separator string, issuance string", order=("at",))


# Derived heads: one letter for each block, which head a document has depends on its key.
HEADS = ("DMNPT", "MNT", "BMBNSPT", "NPT", "MT", "NT", "CNT", "GNT", "JMNSKPT", "XMN", "SNT", "DNST", "mnp", "MXNP", "RNP", "MNNP", "DT", "GT")
_BLOCK = {
    "D": "'特急'", "M": "'某某市人民政府文件'", "N": "'某政发〔2024〕' || q || '号'", "S": "'签发人：张某'", "K": "'李某'", "P": "''", "B": "''", "T": "'关于开展' || q || '项工作的通知'", "C": "'某政发[2024]第' || q || '号'", "G": "''", "J": "'某某市财政局'", "X": "'各部门要落实' || q || '项工作。'",
    "m": "'某某市委员会'", "n": "'某委发〔2023〕' || q || '号签发人：王某'", "p": "''", "R": "'某某市教育局'",
}
BLOCKS = (
    "select doc_id, pos, true as paragraph, case letter " + " ".join(f"when '{k}' then {v}" for k, v in _BLOCK.items()) + " else '各单位要按照分工抓好第' || q || '项任务。' end as text, case when letter in ('M', 'R') then 'FF0000' when letter = 'J' then '333333' end as color, "
    "case when letter in ('M', 'R', 'T') then 'center' else 'left' end as alignment, case when letter = 'R' then 30 when letter = 'M' then 20 else 12 end as size, letter = 'P' and q % 2 = 0 as border, letter = 'P' and q % 2 = 1 as star, letter = 'G' as drawing, "
    f"case letter when 'm' then '{MANAGED[1]}' when 'n' then '{MANAGED[2]}' when 'p' then '{MANAGED[4]}' else 'Normal' end as style, doc_id % 2 = 0 as managed from (select o_custkey as doc_id, o_orderkey as pos, cast(o_orderkey % 50 as int) as q, substr(case o_custkey % {len(HEADS)} "
    + " ".join(f"when {i} then '{h}'" for i, h in enumerate(HEADS)) + " end, cast(row_number() over (partition by o_custkey order by o_orderkey) as int), 1) as letter from orders) a"
)


@query()
def letterhead_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letterhead of every derived document: status, protected blocks and fields."""
    b = spark.sql(BLOCKS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    return letterheads(b)


def _m(pattern: str) -> str:
    return f"regexp_matches(c, '{pattern}')"


@query(f"""with b as ({BLOCKS}), f as (select *, row_number() over (partition by doc_id order by pos) - 1 as spot, regexp_replace(text, '\\s', '', 'g') as c from b)
select doc_id, spot::integer as "at", case when {_m(STANDARD)} then 'standard' when {_m(COMPATIBLE)} then 'compatible' end as number, {_m('^' + _SIGNER + '$')} or (({_m(STANDARD)} or {_m(COMPATIBLE)}) and contains(c, '签发人')) as signer, color = 'FF0000' and ((contains(c, '文件') and length(c) >= 4) or (not contains(c, '文件') and length(c) between 4 and 40 and alignment = 'center' and size >= 26)) is true as red_mark,
  {_m('^' + _AGENCY.removeprefix('(?!关于)') + '文件$')} and not starts_with(c, '关于') as file_mark, {_m('^' + _AGENCY.removeprefix('(?!关于)') + '$')} and not starts_with(c, '关于') as agency, {_m(METADATA)} as metadata, (border or star or contains(c, '★')) and (c = '' or {_m(STANDARD)} or {_m(COMPATIBLE)} or {_m('^' + _SIGNER + '$')}) as separator from f where spot < {TOP}""")
def letterhead_blocks(spark, sf_dir):
    """What each of the first blocks of a document can be."""
    b = spark.sql(BLOCKS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    return block_facts(b).select("doc_id", "at", "number", "signer", "red_mark", "file_mark", "agency", "metadata", "separator")

"""Semantic types of paragraphs: candidates as column expressions, one beam fold per document, review levels.

Every provider that looks at one paragraph (or its neighbours) is a column
expression, so candidates come out of one projection over windows. Only what
depends on the types chosen before, vetoes and transitions, runs in the fold.
"""

from __future__ import annotations

import json
from collections import OrderedDict, namedtuple
from collections.abc import Callable
from functools import lru_cache
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import kernels as K
from quire.functions import predicates as P
from quire.operators import context as C
from quire.operators.alike import Alike, alike
from quire.operators.grouped import per_document
from quire.operators.segments import STYLES
from quire.plans.registry import query
from quire.sources.tables import outline, table

BEAM, MOST = 12, 8
# Sections, and the level of heading types.
SECTION = {"main_title": "header", "title_continuation": "header", "role_name": "header", "date_line": "header", "meeting_title_meta": "header", "dispatch_number": "dispatch_meta", "signature_org": "signature", "signature_date": "signature", "attachment_note": "attachment_note", "attachment_note_item": "attachment_note"}
LEVEL = {"heading_1": 1, "heading_2": 2, "heading_3": 3, "heading_4": 4}
SENSITIVE = {"main_title", "heading_1", "heading_2", "signature_org", "signature_date", "attachment_note"}
MODES = (("meeting_minutes", ("会议纪要", "会议记录"), 0.72, 0.06, 0.99), ("report", ("报告",), 0.55, 0.07, 0.95), ("notice", ("通知",), 0.55, 0.07, 0.95), ("plan", ("实施方案", "工作方案"), 0.55, 0.07, 0.95))


def in_doc():
    return W.partitionBy("doc_id")


def in_order():
    return in_doc().orderBy("pos")


def mode_facts(text: Column) -> list[Column]:
    """What the kind of a document depends on: visible, meta (a meeting label), ending (place in MODES of the title ending)."""
    c = P.compact(text)
    endings = [F.when(c.rlike("(" + "|".join(m[1]) + ")$"), i) for i, m in enumerate(MODES)]
    labels = "^(" + "|".join(K.MEETING_LABELS) + ")[:：]"
    return [F.coalesce(P.visible_length(text) > 0, F.lit(False)).alias("visible"), c.rlike(labels).alias("meta"), F.when(F.length(c).between(4, 60), F.coalesce(*endings)).alias("ending")]


def with_mode(facts: DataFrame) -> DataFrame:
    """facts with mode and mode_confidence of their document: the first of eight visible paragraphs that ends like a kind of document, a meeting's first."""
    placed = facts.withColumns({"place": F.sum(F.col("visible").cast("int")).over(in_order().rowsBetween(W.unboundedPreceding, 0)), "metas": F.count(F.when(F.col("visible") & F.col("meta"), 1)).over(in_doc())})
    i, place = F.col("ending"), F.col("place")
    of = lambda k: F.get(F.array(*[F.lit(m[k]) for m in MODES]), i)
    weight = F.when(i == 0, F.col("metas")).when(place <= 5, 3).otherwise(2)
    found = F.struct((F.when(i == 0, 0).otherwise(100) + place).alias("rank"), of(0).alias("mode"), F.least(of(4), of(2) + of(3) * weight).alias("sure"))
    first = F.min(F.when(F.col("visible") & (place <= 8) & i.isNotNull(), found)).over(in_doc())
    out = placed.withColumn("first", first).withColumns({"mode": F.coalesce("first.mode", F.lit("unknown")), "mode_confidence": F.coalesce("first.sure", F.lit(0.25))})
    return out.drop("place", "metas", "first", "visible", "meta", "ending")


def facts(paragraphs: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, pos) with what a paragraph says by itself; more: further columns, by name."""
    t = F.col("text")
    visible, meta, ending = mode_facts(t)
    own = C.facts(paragraphs, visible=visible, meta=meta, ending=ending, colon_kind=F.col("colon.kind"), org=P.signature_org(t), numbered_item=P.is_attachment_item(t), prose=P.body_like_candidate(t), compact=P.compact(t), styled=F.replace(F.lower(F.trim(F.coalesce("style", F.lit("")))), F.lit(" "), F.lit("")), colons=P.compact(t).rlike("[:：]"), closed=t.rlike(r"\p{P}\s*$"), **more)
    glossary = (F.col("n") <= 20) & (F.col("level") == 0) & ~F.col("colons") & ~F.col("ends") & F.col("compact").rlike("名词解释|注释")
    short = F.col("shown") & (F.col("n") < 28) & (F.col("level") == 0) & ~F.col("colons") & ~F.col("ends") & ~F.col("closed") & ~F.col("date") & ~F.col("recipient")
    return own.withColumns({"glossary": F.when(F.col("compact").isin("名词解释", "注释"), "exact").when(glossary, "like"), "short": short, "annual": F.col("compact").isin("一年来。", "五年来。")}).drop("compact", "closed")


def in_documents(own: DataFrame, *keep: str) -> DataFrame:
    """facts with those that depend on the other paragraphs of the document, its context and mode; keep: further columns."""
    known = C.with_context(own)
    carries = F.col("shown") & (F.col("level") == 0) & ((F.col("n") >= 34) | (F.col("ends") & (F.col("n") >= 12)))
    # One window per level instead of a partition of its own: all of them share the document's shuffle.
    alike = [F.when(F.col("level") == k, F.count(F.when(F.col("level") == k, 1)).over(in_doc())) for k in LEVEL.values()]
    out = known.withColumns({
        "rank": F.col("i"),
        "date_next": F.coalesce(F.lead("date").over(in_order()), F.lit(False)),
        "after_body": F.coalesce(F.max(F.col("prose").cast("int")).over(in_order().rowsBetween(W.unboundedPreceding, -1)) == 1, F.lit(False)),
        "siblings": F.coalesce(*alike, F.lit(0)), "middle": F.coalesce(F.lead(carries).over(in_order()), F.lit(False)),
    })
    return with_mode(out.select(*keep, "styled", "glossary", "short", "annual", "colons", "bold", "middle", "doc_id", "pos", "n", F.col("colon_kind").alias("colon"), "level", "dispatch", "date", "org", "note", F.col("numbered_item").alias("item"), "caption", "prose", "page", "metadata", "title_score", "front", "before_body", "visible", "meta", "ending", "rank", "date_next", "after_body", "siblings"))


def features(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, pos) with the facts that candidates, vetoes and the mode need, and the document's context, every paragraph read.

    The text is dealt by document before anything is read from it: a file of few row groups would keep all the patterns in as few
    tasks. The facts are shuffled once more for the windows.
    """
    return in_documents(facts(paragraphs.repartition("doc_id")))


def classed(paragraphs: DataFrame) -> tuple[Alike, DataFrame]:
    """The classes of documents that say the same, and their paragraphs with candidates and how many documents a class has."""
    classes = alike(paragraphs, facts)
    return classes, with_candidates(in_documents(classes.rows, "documents"))


PROVIDERS: dict[str, Callable[[], list[Column]]] = {}


def provider(function: Callable[[], list[Column]]) -> Callable[[], list[Column]]:
    """Register a provider of candidates under its name: a function of no arguments that gives proposals over the columns of ``features``."""
    PROVIDERS[function.__name__] = function
    return function


def proposal(kind, score, source: str, hard: bool | Column = False) -> Column:
    """struct(soft, cost, type, source); cost is the negative score."""
    hard = hard if isinstance(hard, Column) else F.lit(hard)
    return F.struct((~hard).alias("soft"), (-(score if isinstance(score, Column) else F.lit(float(score)))).alias("cost"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), F.lit(source).alias("source"))


def propose(when: Column, kind, score, source: str, hard: bool | Column = False) -> Column:
    return F.when(when, proposal(kind, score, source, hard))


c = F.col


@provider
def structural() -> list[Column]:
    return [
        propose(c("caption") & (c("n") <= 40), "caption", 1.0, "structural", True),
        propose(c("dispatch"), "dispatch_number", 1.0, "structural", True),
        propose(c("date") & c("after_body"), "signature_date", 0.97, "structural", True),
        propose(c("org") & c("date_next"), "signature_org", 0.97, "structural", True),
        propose(c("colon") == "addressing", "addressing", 0.99, "structural", True),
        propose(c("colon").isin("recipient_candidate", "body_label") & ~c("after_body") & (c("rank") < 12), "recipient", 0.95, "structural", True),
        propose(c("note"), "attachment_note", 0.98, "structural", True),
        propose(c("item"), "attachment_note_item", 0.60, "structural"),
    ]


@provider
def front() -> list[Column]:
    """Metadata of the head, by the document's context."""
    head = lambda kind: F.coalesce(c("before_body") & (c("metadata") == kind), F.lit(False))
    return [
        propose((c("date") & ~c("after_body")) | head("date_line"), "date_line", 0.97, "front"),
        propose(head("role_name"), "role_name", 0.97, "front"),
        propose(head("meeting_title_meta"), "meeting_title_meta", 0.97, "front"),
    ]


@provider
def key_value() -> list[Column]:
    return [propose(c("colon") == "key_value", "key_value", 0.92, "key_value")]


@provider
def semantic() -> list[Column]:
    """Titles by the score of the context."""
    title = c("title_score") / 100
    return [
        propose(c("title_score") >= C.LEAST_TITLE, "main_title", title, "semantic"),
        propose(c("front") & (c("title_score") >= C.LEAST_NEXT), "title_continuation", F.greatest(F.lit(0.86), F.least(F.lit(0.95), title + 0.20)), "semantic"),
    ]


@provider
def numbering() -> list[Column]:
    sure = 0.80 + F.when(c("siblings") >= 2, 0.18).otherwise(0.0) - F.when((c("siblings") < 2) & ~c("after_body") & (c("level") == 1), 0.22).otherwise(0.0)
    return [propose(c("level") > 0, F.concat(F.lit("heading_"), c("level").cast("string")), F.least(F.lit(0.96), F.greatest(F.lit(0.35), sure)), "numbering")]


@provider
def inline_heading() -> list[Column]:
    """The lead of an annual review, which segmentation has cut off, is a heading in a report."""
    return [propose(c("annual") & (c("mode") == "report"), "heading_1", 0.94, "inline-heading", True)]


@provider
def body_title() -> list[Column]:
    """Short unnumbered headings of the body; what stands before them is looked at by the beam."""
    score = 0.64 + F.when(c("mode") == "report", 0.08).otherwise(0.0) + F.when(c("bold"), 0.08).otherwise(0.0)
    return [propose(c("short") & ~(c("front") & (c("title_score") >= C.LEAST_NEXT)), "title2", score, "body-title")]


@provider
def glossary() -> list[Column]:
    """The heading of a glossary and its items; whether a glossary is open is a state of the beam."""
    return [
        propose(c("glossary").isNotNull(), "glossary_title", 0.96, "glossary", c("glossary") == "exact"),
        propose((c("n") >= 4) & (c("colons") | (c("level") == 3)) & c("glossary").isNull(), "glossary_item", 0.96, "glossary", True),
    ]


@provider
def style() -> list[Column]:
    """Weak proposals from the name of a paragraph's style."""
    kinds, scores = (F.create_map(*[F.lit(x) for s in STYLES for x in (s[0], s[i])])[c("styled")] for i in (1, 2))
    return [propose(kinds.isNotNull(), kinds, scores, "style")]


@provider
def prose() -> list[Column]:
    """Three ways to propose body; the first that does is the strongest."""
    return [F.when(c("colon").isin("explanatory_body", "body_label") & c("after_body"), proposal("body", 0.98, "structural", True)).when(c("prose"), proposal("body", 0.82, "prose")).otherwise(proposal("body", 0.45, "lifecycle"))]


def with_candidates(facts: DataFrame) -> DataFrame:
    """facts with candidates, the strongest of each type, best first by (hard, score, type): all hard ones, and soft ones up to MOST in all."""
    every = facts.withColumn("every", F.array_compact(F.array(*[x for of in PROVIDERS.values() for x in of()])))
    # Sorted by (soft, cost, type, source), the first of a type is its strongest.
    ranked = every.withColumn("ranked", F.array_sort("every"))
    kinds = ranked.withColumn("kinds", F.transform("ranked", lambda x: x["type"]))
    ordered = kinds.withColumn("ordered", F.filter("ranked", lambda x, i: F.array_position("kinds", x["type"]) == i + 1))
    hard = F.size(F.filter("ordered", lambda x: ~x["soft"]))
    return ordered.withColumn("candidates", F.slice("ordered", F.lit(1), F.greatest(hard, F.lit(MOST)))).drop("every", "ranked", "kinds", "ordered")


DEPENDENT = ("title_continuation", "title2", "glossary_title", "glossary_item")  # proposed only behind certain types


def vetoed(kind: str, row, before: str | None, titled: bool, glossary: int = 0) -> bool:
    """Structural facts that no score outweighs. glossary: 2 behind a title or item of one, 1 after one paragraph of body, else 0."""
    opened = row.before_body and before in ("main_title", "title_continuation")
    if kind == "glossary_item":
        return not glossary
    if kind == "glossary_title":
        return not (before in LEVEL or before in ("body", "title2") or opened)
    if kind == "title2":
        inside = not row.before_body and (before in LEVEL or before in ("body", "addressing", "title2", "glossary_item"))
        return not (opened or (inside and (row.bold or (before == "body" and row.middle))))
    if kind in ("main_title", "title_continuation") and (not row.before_body or row.metadata or (kind == "main_title" and titled)):
        return True
    if row.dispatch and kind != "dispatch_number":
        return True
    recipient = row.colon in ("recipient_candidate", "body_label")
    if kind == "title_continuation":
        return row.date or recipient or before not in ("main_title", "title_continuation")
    level = LEVEL.get(kind)
    if level is None:
        return False
    if row.date or row.note or row.page or recipient or row.colon in ("key_value", "explanatory_body"):
        return True
    return (before in LEVEL and level > LEVEL[before] + 1) or (before in ("attachment_note", "attachment_note_item") and row.shape > 0)


def transition(before: str | None, kind: str, section: str | None, mode: str) -> float:
    """The first rule that fits a pair of neighbouring types. A main title is only proposed for its place in the front, so it pays nothing for a section before it."""
    now = SECTION.get(kind, "body")
    rules = (
        (before == "main_title" and kind == "title_continuation", 0.18),
        (before == "title_continuation" and kind == "dispatch_number", 0.30),
        (before in ("heading_1", "heading_2") and kind == "meeting_meta", 0.05),
        (section == "signature" and now == "body", -0.08),
        (kind == "main_title", 0.0),
        (section in ("body", "signature", "attachment_note") and now in ("header", "dispatch_meta"), -0.40),
        (mode == "meeting_minutes" and kind == "meeting_meta", 0.04),
    )
    return next((score for fits, score in rules if fits), 0.0)


def between(kind: str, row, before: str | None) -> float:
    """What a body title gains between two paragraphs of prose."""
    return 0.10 if kind == "title2" and before == "body" and row.middle else 0.0


def after(state: tuple[bool, int], kind: str) -> tuple[bool, int]:
    """(title seen, glossary) behind a type; a glossary survives one paragraph of body and ends at the second."""
    titled, glossary = state
    return titled or kind == "main_title", 2 if kind in ("glossary_title", "glossary_item") else 1 if kind == "body" and glossary == 2 else 0


def beam(rows: list, mode: str, width: int = BEAM) -> list[tuple[str, float, bool]]:
    """(type, candidate score, whether all were vetoed) of the best path; ties go to type names in order.

    A path is a chain of back-pointers, so a long document costs its length. What may follow depends only on the
    type before, on whether a title was seen and on an open glossary: it is found once for each such state of a row.
    """
    ends = [(0.0, 0, None, (False, 0), None)]  # negative score, place among the paths by type names, type, (title seen, glossary), (path before, score, conflict)
    for row in rows:
        proposed = list(zip(row.types, (-x for x in row.costs), row.softs))
        follow: dict = {}
        grown = []
        for end in ends:
            cost, place, before, state, _ = end
            if (before, state) not in follow:
                fit = [c for c in proposed if not vetoed(c[0], row, before, *state)]
                section = SECTION.get(before, "body") if before else None
                follow[before, state] = [(kind, score, score + transition(before, kind, section, mode) + between(kind, row, before)) for kind, score, soft in fit if not soft or all(c[2] for c in fit)]
            for kind, score, gain in follow[before, state]:
                grown.append((cost - gain, (place, kind), kind, after(state, kind), (end, score, False)))
        if not grown:
            grown = [(end[0], (end[1], "body"), "body", after(end[3], "body"), (end, 0.0, True)) for end in ends]
        best = sorted(grown, key=lambda p: (round(p[0], 9), p[1]))[:width]
        places = {names: i for i, names in enumerate(sorted(p[1] for p in best))}
        ends = [(cost, places[names], kind, state, back) for cost, names, kind, state, back in best]
    out, end = [], ends[0]
    while end[4] is not None:
        end, (kind, score, conflict) = end[4][0], (end[2], *end[4][1:])
        out.append((kind, score, conflict))
    return out[::-1]


def detect_mode(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, mode, confidence) of every document."""
    m = with_mode(paragraphs.select("doc_id", "pos", *mode_facts(F.col("text"))))
    return m.groupBy("doc_id").agg(F.any_value("mode").alias("mode"), F.any_value("mode_confidence").alias("confidence"))


# What the beam and the review read of a paragraph; the mode is the document's.
Facts = namedtuple("Facts", "mode types costs softs before_body dispatch date colon note page metadata shape bold middle siblings")
REMEMBERED, LONGEST = 1 << 16, 32


@lru_cache(REMEMBERED)
def _read(facts: str) -> tuple[int, Facts]:
    """(number, facts) of a row's JSON: equal rows, which are frequent, are read once and have one number."""
    told = json.loads(facts)
    return next(_NUMBERS), Facts(*map(told.get, Facts._fields))


_NUMBERS = count()


def _decided(rows: list[Facts]) -> list[tuple]:
    """(type, score, margin, confidence, level, conflict) of every row of a document."""
    out, before, state = [], None, (False, 0)
    for row, (kind, score, conflict) in zip(rows, beam(rows, rows[0].mode)):
        other = [-x for t, x in zip(row.types, row.costs) if t != kind and not (t in DEPENDENT and vetoed(t, row, before, *state))]
        before, state = kind, after(state, kind)
        hard = any(t == kind and not soft for t, soft in zip(row.types, row.softs))
        margin = score - max(other) if other else None
        strength = 1.0 if hard else 0.92 if kind == "key_value" else 0.93 if kind in LEVEL and row.siblings > 1 else 0.70 if kind in LEVEL else 0.45
        out.append((kind, score, margin, *review(score, margin, strength, kind, conflict, row.shape)))
    return out


def decode(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, pos, type, score, margin, confidence, level, conflict) of every paragraph."""
    classes, found = classed(paragraphs)
    return classes.to_paragraphs(decided(found))


_KNOWN: OrderedDict[tuple[int, ...], list[tuple]] = OrderedDict()


def _decided_once(facts: list[str]) -> list[tuple]:
    """_decided of a document; a worker remembers short documents."""
    read = [_read(x) for x in facts]
    key = tuple(n for n, _ in read)
    if key in _KNOWN:
        _KNOWN.move_to_end(key)
        return _KNOWN[key]
    found = _decided([x for _, x in read])
    if len(key) <= LONGEST:
        _KNOWN[key] = found
        if len(_KNOWN) > REMEMBERED:
            _KNOWN.popitem(last=False)
    return found


def decided(candidates: DataFrame, **more: Column) -> DataFrame:
    """decode of paragraphs with their candidates; more: columns that stay as they are, by name.

    A document is one group of its paragraphs; groups are as large as a document. The result depends on the facts
    alone, so of short documents with the same facts in the same order a worker decodes one, as far as it remembers them.
    """
    part = lambda name: F.transform("candidates", lambda c: c[name])
    own = {"shape": F.col("level"), "types": part("type"), "costs": part("cost"), "softs": part("soft")}
    facts = F.struct(*[own.get(n, F.col(n)).alias(n) for n in Facts._fields])
    keep = candidates.select("doc_id", "pos", F.to_json(facts).alias("facts"), *[x.alias(n) for n, x in more.items()])

    def run(rows: list) -> list[tuple]:
        return [(r.doc_id, r.pos, *x, *r[3:]) for r, x in zip(rows, _decided_once([r.facts for r in rows]))]

    kept = "".join(f", {x.name} {x.dataType.simpleString()}" for x in keep.schema.fields[3:])
    return per_document(keep, run, "doc_id bigint, pos int, type string, score double, margin double, confidence double, level string, conflict boolean" + kept)


def review(score: float, margin: float | None, strength: float, kind: str, conflict: bool, shape: int) -> tuple[float, str, bool]:
    """Review confidence and level: how strong the evidence is, apart from the ranking of candidates."""
    unit = lambda x: max(0.0, min(1.0, x))
    sure = round(unit(0.35 * unit((score - 0.5) / 0.45) + 0.25 * (1.0 if margin is None else unit((margin + 0.02) / 0.2)) + 0.40 * strength), 4)
    direct, changed = strength >= 0.86, bool(shape) != (kind in LEVEL)
    rules = (
        ("critical_review", conflict), ("critical_review", changed and not direct and kind in SENSITIVE), ("review", changed and not direct),
        ("review", not direct and margin is not None and margin < 0.08), ("review", not direct and sure < 0.6), ("info", changed),
    )
    return sure, next((level for level, fits in rules if fits), "confirmed"), conflict


def documents(spark, sf_dir: str) -> DataFrame:
    """Derived official documents: a title, a dispatch number, the outline, a signature and a date."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    title = F.when(k == 0, "关于推进公共服务工作的通知").when(k == 1, "2026年第一次党委会会议纪要").when(k == 2, "年度重点工作报告").otherwise("公共服务实施方案")
    extra = F.array(
        F.struct(F.lit(-3).alias("pos"), title.alias("text")),
        F.struct(F.lit(-2).alias("pos"), F.concat(F.lit("内政发〔2026〕"), F.col("o_custkey").cast("string"), F.lit("号")).alias("text")),
        F.struct(F.lit(-1).alias("pos"), F.when(k == 1, "时间：8月20日上午").otherwise("各相关单位：").alias("text")),
        F.struct(F.lit(50).alias("pos"), F.lit("现将有关事项说明如下，请各单位结合实际认真贯彻落实。").alias("text")),
        F.struct(F.lit(60).alias("pos"), F.lit("公共服务管理办公室").alias("text")),
        F.struct(F.lit(61).alias("pos"), F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), F.month("o_orderdate").cast("string"), F.lit("月"), F.dayofmonth("o_orderdate").cast("string"), F.lit("日")).alias("text")),
    )
    own = o.select(F.col("o_orderkey").alias("doc_id"), F.inline(extra))
    return own.unionByName(outline(spark, sf_dir).select("doc_id", "pos", "text"))


def free() -> Column:
    """The candidates that do not depend on what stands before, best first."""
    return F.filter("candidates", lambda x: ~x["type"].isin(*DEPENDENT))


@query()
def strongest_candidates(spark, sf_dir):
    """The best context-free candidate of every paragraph."""
    classes, found = classed(documents(spark, sf_dir))
    f = found.withColumn("best", F.get(free(), F.lit(0)))
    return classes.to_paragraphs(f.select("doc_id", "pos", "best.type", (-F.col("best.cost")).alias("score"), "best.source", (~F.col("best.soft")).alias("hard")))


@query()
def beam_decode_types(spark, sf_dir):
    """Types of all paragraphs by a beam of twelve over each document."""
    return decode(documents(spark, sf_dir))


@query("select o_orderkey as doc_id, ['notice', 'meeting_minutes', 'report', 'plan'][o_orderkey % 4 + 1] as mode, case when o_orderkey % 4 = 1 then least(0.99::double, 0.72::double + 0.06::double * 1) else least(0.95::double, 0.55::double + 0.07::double * 3) end as confidence from orders")
def document_modes(spark, sf_dir):
    """Kind of every document from its first visible paragraphs."""
    return detect_mode(documents(spark, sf_dir))


@query()
def review_levels(spark, sf_dir):
    """Decoded types by review level, with mean confidence in hundredths."""
    n = F.col("documents")
    every = decided(classed(documents(spark, sf_dir))[1], documents=n)
    return every.groupBy("type", "level").agg(F.sum("documents").alias("n"), F.sum(F.when(F.col("conflict"), n).otherwise(0)).alias("conflicts"), F.round(F.sum(F.col("confidence") * n) / F.sum(n) * 100).cast("bigint").alias("confidence"))


@query()
def candidate_quality(spark, sf_dir):
    """How many candidates paragraphs have, which are hard, and their softmax confidence."""
    n = F.col("documents")
    f = classed(documents(spark, sf_dir))[1].withColumn("candidates", free()).withColumn("c", F.transform("candidates", lambda x: -x["cost"]))
    best = F.array_max("c")
    total = F.aggregate("c", F.lit(0.0), lambda a, s: a + F.exp(s - best))
    return f.groupBy(F.size("c").alias("candidates")).agg(F.sum("documents").alias("paragraphs"), F.sum(F.when(F.exists("candidates", lambda x: ~x["soft"]), n).otherwise(0)).alias("with_hard"), F.round(F.sum(n / total) / F.sum(n), 3).alias("softmax"))


@query()
def candidate_softmax_margin(spark, sf_dir):
    """Best candidate of each paragraph, its margin over the next other type, and its softmax among all candidates of the beam."""
    classes, found = classed(documents(spark, sf_dir))
    f = found.withColumn("candidates", free()).withColumns({"score": F.transform("candidates", lambda x: -x["cost"]), "first": F.array_min(F.transform("candidates", lambda x: F.struct(x["cost"].alias("cost"), x["type"].alias("type"))))})
    other = F.array_max(F.transform(F.filter("candidates", lambda x: x["type"] != F.col("first.type")), lambda x: -x["cost"]))
    total = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x + F.col("first.cost")))
    return classes.to_paragraphs(f.select("doc_id", "pos", F.col("first.type").alias("type"), (-F.col("first.cost") - other).alias("margin"), (-F.col("first.cost")).alias("best"), (1.0 / total).alias("confidence")))


LOW = 0.60


def summary(paragraphs: DataFrame) -> DataFrame:
    """One row a document: its mode, how many paragraphs and candidates it has, what decided them, and how sure the decisions are."""
    classes, found = classed(paragraphs)
    every = decided(found, mode=F.col("mode"), n=F.size("candidates"), hard=F.exists("candidates", lambda x: ~x["soft"]), sources=F.size(F.array_distinct(F.transform("candidates", lambda x: x["source"]))))
    level = lambda x: F.count_if(F.col("level") == x).alias(x)
    told = every.groupBy("doc_id").agg(
        F.any_value("mode").alias("mode"), F.count("*").alias("paragraphs"), F.sum("n").alias("candidates"), F.max("n").alias("most_candidates"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") == 2).alias("double"), F.count_if(F.col("n") > 2).alias("more"),
        F.count_if("hard").alias("with_hard"), F.max("sources").alias("most_providers"),
        *[level(x) for x in ("confirmed", "info", "review", "critical_review")], F.count_if(F.col("level").isin("review", "critical_review")).alias("needs_review"), F.count_if(F.col("confidence") < LOW).alias("low_confidence"), F.count_if("conflict").alias("conflicts"),
        F.count_if(F.col("type").startswith("heading_")).alias("headings"), F.count_distinct("type").alias("types"),
    )
    return classes.to_documents(told).drop("at").withColumn("beam", F.lit(BEAM))


@query()
def recognition_summary(spark, sf_dir):
    """Summary of the recognition of every document."""
    return summary(documents(spark, sf_dir))

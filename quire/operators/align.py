"""Alignment of two versions of a document: order-preserving weighted matching, and longest matching blocks by region.

A task holds one document at a time and for it a few rows of a table, never the table: rows and columns without a
partner go first, pairs that every optimal matching holds cut the rest into pieces, and a piece is walked row by row with
checkpoints.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.operators.grouped import per_document
from quire.plans.registry import query
from quire.sources.tables import lines

RAW, CANONICAL = 100, 80
MOST_POINTS = 64  # times the lines of both sides: beyond, equal pairs are found anew for each range instead of being listed


def _ids(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return tuple(np.array([known.setdefault(x, len(known)) for x in side], np.int64) for side in (a, b))


def _step(best: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The row of best weights below ``best``: the best order-preserving matching with one more row."""
    out = best.copy()
    np.maximum(out[1:], np.where(score > 0, best[:-1] + score, 0), out=out[1:])
    return np.maximum.accumulate(out)


def optimal(rows: int, columns: int, score: Callable[[int], np.ndarray]) -> list[np.ndarray]:
    """For each row the columns that some optimal order-preserving matching gives it.

    score(i) is row i of the weights. Rows of best weights are kept at every k-th row, k the root of their number, and computed
    again in between, so memory grows with columns times that root.
    """
    if not rows:
        return []
    k = max(1, int(rows**0.5))
    best = np.zeros(columns + 1, np.int64)
    kept = []
    for i in range(rows):
        if i % k == 0:
            kept.append(best)
        best = _step(best, score(i))
    most, behind, out = int(best[-1]), np.zeros(columns + 1, np.int64), [np.zeros(0, np.int64)] * rows
    for start in range((rows - 1) // k * k, -1, -k):
        ahead, block = kept[start // k], []
        for i in range(start, min(start + k, rows)):
            block.append(ahead)
            ahead = _step(ahead, score(i))
        for i in range(min(start + k, rows) - 1, start - 1, -1):
            points = score(i)
            out[i] = np.flatnonzero((points > 0) & (block[i - start][:-1] + points + behind[1:] == most))
            behind = _step(behind[::-1], points[::-1])[::-1]
    return out


def align(plan: list, host: list) -> list[tuple]:
    """State of every plan paragraph: a host place is a candidate if some optimal matching uses it. Rows have raw and canonical digests; equal raw ones have equal canonical ones."""
    a, b = _ids([p.canonical for p in plan], [h.canonical for h in host])
    raw_a, raw_b = _ids([p.raw for p in plan], [h.raw for h in host])
    row_at, col_at = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    a, b, raw_a, raw_b = a[row_at], b[col_at], raw_a[row_at], raw_b[col_at]

    # A pair is in every optimal matching if all other equal pairs lie before both or behind both of its ends.
    first, last = {}, {}
    for j, x in enumerate(b.tolist()):
        first.setdefault(x, j)
        last[x] = j
    low, high = np.array([first[x] for x in a.tolist()], np.int64), np.array([last[x] for x in a.tolist()], np.int64)
    before = np.concatenate([[-1], np.maximum.accumulate(high)[:-1]]) if len(a) else high
    behind = np.concatenate([np.minimum.accumulate(low[::-1])[::-1][1:], [len(b)]]) if len(a) else low
    sure = np.flatnonzero((low == high) & (before < low) & (behind > high))

    candidates: list = [None] * len(a)
    edges = [(-1, -1), *((int(i), int(low[i])) for i in sure), (len(a), len(b))]
    for (r0, c0), (r1, c1) in zip(edges, edges[1:]):
        cols = slice(c0 + 1, c1)

        def score(i: int) -> np.ndarray:
            return np.where(b[cols] == a[r0 + 1 + i], np.where(raw_b[cols] == raw_a[r0 + 1 + i], RAW, CANONICAL), 0)

        for i, found in enumerate(optimal(r1 - r0 - 1, c1 - c0 - 1, score)):
            candidates[r0 + 1 + i] = found + c0 + 1
        if r1 < len(a):
            candidates[r1] = np.array([c1])
    places = dict(zip(row_at.tolist(), candidates))
    out = []
    for i, p in enumerate(plan):
        found = places.get(i, ())
        one = len(found) == 1
        exact = one and host[col_at[found[0]]].raw == p.raw
        status = ("matched_unique" if exact else "matched_review") if one else "ambiguous" if len(found) else "unmatched"
        out.append((p.doc_id, p.pos, status, int(host[col_at[found[0]]].pos) if one else None, len(found)))
    return out


def blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, start, length) of matching blocks: the longest first (the earliest of equals), then those left and right of it, and so on."""
    shared = np.intersect1d(a, b)
    points = (np.bincount(a, minlength=int(max(a.max(initial=0), b.max(initial=0))) + 1)[shared] * np.bincount(b, minlength=1 + int(max(a.max(initial=0), b.max(initial=0))))[shared]).sum()
    longest = _from_runs(a, b) if points <= MOST_POINTS * (len(a) + len(b)) else _by_rows(a, b)
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        i, j, n = longest(i0, i1, j0, j1)
        if n:
            out.append((i, j, n))
            todo += [(i0, i, j0, j), (i + n, i1, j + n, j1)]
    return sorted(out)


def _from_runs(a: np.ndarray, b: np.ndarray) -> Callable:
    """The longest block of a range from the maximal diagonal runs of all equal pairs."""
    at = defaultdict(list)
    for j, x in enumerate(b.tolist()):
        at[x].append(j)
    pairs = np.array([(j - i, i) for i, x in enumerate(a.tolist()) for j in at.get(x, ())], np.int64).reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] != pairs[:-1, 1] + 1)
    start = np.flatnonzero(new)
    diagonal, low = pairs[start, 0], pairs[start, 1]
    high = low + np.diff(np.append(start, len(pairs)))

    def longest(i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int]:
        left = np.maximum(low, max(i0, 0))
        left = np.maximum(left, j0 - diagonal)
        size = np.minimum(np.minimum(high, i1), j1 - diagonal) - left
        if not len(size) or (most := int(size.max())) <= 0:
            return i0, j0, 0
        best = np.flatnonzero(size == most)
        k = best[np.lexsort((left[best] + diagonal[best], left[best]))[0]]
        return int(left[k]), int(left[k] + diagonal[k]), most

    return longest


def _by_rows(a: np.ndarray, b: np.ndarray) -> Callable:
    """The longest block of a range by one row of lengths at a time."""

    def longest(i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int]:
        best, own, row = (i0, j0, 0), b[j0:j1], np.zeros(j1 - j0 + 1, np.int64)
        for i in range(i0, i1):
            new = np.zeros_like(row)
            new[1:] = np.where(own == a[i], row[:-1] + 1, 0)
            n = int(new.max())
            j = int(new.argmax())
            if n and (n, -(i - n + 1), -(j0 + j - n)) > (best[2], -best[0], -best[1]):
                best = (i - n + 1, j0 + j - n, n)
            row = new
        return best

    return longest


def by_document(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(left rows, right rows) for every doc_id of either table, both in order of pos."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return per_document(both, lambda rows: run([r for r in rows if r.side == 0], [r for r in rows if r.side == 1]), schema, order=("side", "pos"))


def alignment(plan: DataFrame, host: DataFrame) -> DataFrame:
    """Order-preserving weighted alignment per document; both sides are (doc_id, pos, raw, canonical) with digests."""
    return by_document(plan, host, align, "doc_id bigint, pos int, status string, host_pos bigint, candidates bigint")


def region_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, region, identity) of two versions paired within their region: (doc_id, region, pos, other), one null where a line has no partner. A line without identity meets none."""

    def run(a: list, b: list) -> list[tuple]:
        out = []
        for region in sorted({r.region for r in (*a, *b)}):
            x, y = ([r for r in side if r.region == region] for side in (a, b))
            first, second = _ids([r.identity or (0, r.pos) for r in x], [r.identity or (1, r.pos) for r in y])
            pairs = {i + k: j + k for i, j, n in blocks(first, second) for k in range(n)}
            met = set(pairs.values())
            out += [(r.doc_id, region, r.pos, y[pairs[i]].pos if i in pairs else None) for i, r in enumerate(x)]
            out += [(r.doc_id, region, None, r.pos) for j, r in enumerate(y) if j not in met]
        return out

    return by_document(left, right, run, "doc_id bigint, region string, pos int, other int")


def _identity(t: Column, prefix: Column, heading: Column, date: Column) -> Column:
    dated, numbered = P.strict_date(date), (prefix != "") & (heading != "")
    reason = F.when(t == "", "empty").when(dated, "date_normalization").when(numbered, "heading_number_normalization").otherwise("exact_text")
    value = F.when(t == "", None).when(dated, F.concat(F.lit("date:"), date)).when(numbered, F.concat(F.lit("heading:"), heading)).otherwise(t)
    return F.struct(F.sha2(value, 256).alias("identity"), reason.alias("reason"))


def _shown(text: Column) -> Column:
    return F.regexp_replace(P.strip(text), f"{P.SPACE}+", " ")


def _heading(t: Column, prefix: Column) -> Column:
    return F.regexp_replace(P.strip(F.substr(t, F.length(prefix) + 1)), r"\s*。$", "")


def identity(text: Column) -> Column:
    """struct(identity, reason): what stays of a line when numbers of headings, their last full stop and the form of dates are left out; null for an empty line."""
    t = _shown(text)
    prefix = P.heading_prefix(t)
    return _identity(t, prefix, _heading(t, prefix), P.normalize_sign_date(t))


def with_identity(df: DataFrame, text: Column) -> DataFrame:
    """df with the identity of a text as column i. Its steps are columns of their own, as each is used several times by the next; as one expression it would be evaluated anew at each use."""
    t, prefix = F.col("i__t"), F.col("i__prefix")
    df = df.withColumn("i__t", _shown(text)).withColumns({"i__prefix": P.heading_prefix(t), "i__date": P.normalize_sign_date(t)}).withColumn("i__heading", _heading(t, prefix))
    return df.withColumn("i", _identity(t, prefix, F.col("i__heading"), F.col("i__date"))).drop("i__t", "i__prefix", "i__date", "i__heading")


def _digests(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", "pos", F.sha2(text, 256).alias("raw"), F.sha2(F.regexp_replace(F.trim(text), r"\s+", " "), 256).alias("canonical"))


@query()
def alignment_lcs(spark, sf_dir):
    """Plan paragraphs aligned with a host copy that lost some lines and has other white space in others."""
    t = lines(spark, sf_dir).where(F.trim("text") != "")
    host = t.where("pos % 6 <> 4").withColumn("text", F.when(F.col("pos") % 5 == 2, F.concat("text", F.lit("  "))).otherwise(F.col("text")))
    return alignment(_digests(t, "text"), _digests(host, "text"))


@query()
def binding_decisions(spark, sf_dir):
    """Binding per block from its alignment: confirmed, review or unresolved, with confidence and evidence."""
    a = alignment_lcs(spark, sf_dir)
    level = F.when(F.col("status") == "matched_unique", "confirmed").when(F.col("status") == "matched_review", "review").otherwise("unresolved")
    sure = F.when(level == "confirmed", 1.0).when(level == "review", 0.93).otherwise(0.0)
    code = F.when(F.col("status") == "ambiguous", "SOURCE_OCCURRENCE_AMBIGUOUS").when(F.col("status") == "unmatched", "PHYSICAL_PARAGRAPH_UNMATCHED").when(F.col("status") == "matched_review", "RAW_TEXT_NORMALIZED")
    return a.select("doc_id", "pos", level.alias("binding"), sure.alias("confidence"), "host_pos", code.alias("warning"))


def versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The lines of documents by region, and a version that lost some, repeats some and numbers some."""
    t = lines(spark, sf_dir).withColumn("region", F.when(F.col("pos") == 0, "front").when(F.col("pos") % 13 == 12, "attachment").otherwise("body"))
    other = t.where("pos % 7 <> 3").withColumn("text", F.when((F.col("pos") % 5 == 2) & (F.trim("text") != ""), F.concat(F.lit("一、"), "text", F.lit("。"))).otherwise(F.col("text")))
    named = lambda df, text: with_identity(df, text).select("doc_id", "pos", "region", "i.identity")
    return named(t, F.when(F.col("pos") % 5 == 2, F.concat(F.lit("二、"), "text")).otherwise(F.col("text"))), named(other, F.col("text"))


@query()
def region_sequence_match(spark, sf_dir):
    """Two versions of a document paired region by region: lines paired, lines of each without a partner, and their similarity."""
    p = region_pairs(*versions(spark, sf_dir))
    both = F.count_if(F.col("pos").isNotNull() & F.col("other").isNotNull())
    sums = p.groupBy("doc_id", "region").agg(both.alias("paired"), F.count_if(F.col("other").isNull()).alias("missing"), F.count_if(F.col("pos").isNull()).alias("added"))
    return sums.withColumn("ratio", F.round(2 * F.col("paired") / (2 * F.col("paired") + F.col("missing") + F.col("added")), 6))

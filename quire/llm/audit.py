"""Filter interaction audit by a permutation trie (op13).

Every order of the filters is a path of a trie. The trie is walked depth first: a filter is
applied to the stored survivors of the filters before it, and what it removes is counted at that
edge. Survivors depend on the set of the filters applied, not on their order, so a state
is kept by its set and reached once: five filters have 120 orders and 325 edges, but only 31
stored tables and 80 edges that differ. Orders, what a filter removes on average over them
(its Shapley value), what it would remove alone and what only it removes all follow from the edges.

The texts are read once, for the flags of the filters; the tables of survivors hold flags only.

Edge cases: a null text is empty, a null part the empty string. A null id has no
smaller ids and no labels, and is smaller than none. Repeated rows count each; a document with the same id is no copy of a
smaller one. A label that any row of an id gives counts once. Null flags count as passing. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, keyed_join, materialize, shared_dir

SPACE = r"\x20\x09-\x0D"


def survivors(rows: DataFrame, filters: Sequence[str]) -> tuple[dict[frozenset, DataFrame], list[str]]:
    """The stored survivors of every set of filters that leaves some to apply, and their folders."""
    states, folders = {}, []

    def visit(applied: frozenset, left: DataFrame) -> None:
        states[applied] = left
        for f in filters:
            after = applied | {f}
            if f not in applied and after not in states and len(after) < len(filters):
                folders.append(shared_dir(rows.sparkSession))
                visit(after, materialize(left.where(~F.col(f)), folders[-1]))

    visit(frozenset(), rows)
    return states, folders


def edges(rows: DataFrame, filters: Sequence[str], part: str, marks: Sequence[str]) -> DataFrame:
    """(part, state, filter, here, removed, lost_<mark>): what each filter finds and removes after each set of others; state has a bit for each filter applied."""
    states, folders = survivors(rows, filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    found = None
    for applied, left in states.items():
        one = left.select(F.lit(sum(bit[f] for f in applied)).alias("state"), part, *filters, *marks)
        found = one if found is None else found.union(one)
    each = [F.count("*").alias("here")]
    for f in filters:
        each += [F.count_if(F.col(f)).alias(f"removed_{f}"), *[F.count_if(F.col(f) & F.col(m)).alias(f"{m}_{f}") for m in marks]]
    counts = found.groupBy("state", part).agg(*each)  # at most 2^filters rows a part
    rows_of = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(bit[f]).alias("bit"), F.col(f"removed_{f}").alias("removed"), *[F.col(f"{m}_{f}").alias(f"lost_{m}") for m in marks]) for f in filters])
    out = counts.select(part, "state", "here", F.explode(rows_of).alias("x")).where(F.col("state").bitwiseAND(F.col("x.bit")) == 0)
    out = materialize(out.select(part, "state", "here", "x.filter", "x.removed", *[f"x.lost_{m}" for m in marks]))
    for folder in folders:
        drop(rows.sparkSession, folder)
    return out


def audit(rows: DataFrame, filters: Sequence[str], part: str = "part", marks: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of filters and step, from rows with a boolean column for each filter (fails) and mark.

    rows: a stored table, as it is read again and again. Columns: part, filter_order (the names joined), step, kept, removed,
    redundant, unique_fails, lost_<mark>, shapley.
    """
    n, all_ = len(filters), (1 << len(filters)) - 1
    bit = {f: 1 << i for i, f in enumerate(filters)}
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *marks)]
    found = edges(rows.select(part, *flags), filters, part, marks)
    weight = [factorial(k) * factorial(n - 1 - k) for k in range(n)]  # orders in which a state of k filters comes just before a given other one
    own = F.create_map(*[F.lit(x) for f in filters for x in (f, bit[f])])
    whole = found.groupBy(part, "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(F.col("state") == all_ - own[F.col("filter")], F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * F.get(F.array(*[F.lit(w) for w in weight]), F.bit_count("state"))).alias("shapley"),
    )
    # A state in which a part has no survivors has no row; its counts are zero.
    steps = [("".join(order), k + 1, order[k], sum(bit[f] for f in order[:k])) for order in permutations(filters) for k in range(n)]
    trie = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state int")
    paths = F.broadcast(trie).join(whole, "filter").withColumnRenamed(part, "at").join(found.withColumnsRenamed({"filter": "f", "state": "s", part: "p"}), (F.col("filter") == F.col("f")) & (F.col("state") == F.col("s")) & (F.col("at") == F.col("p")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return paths.select(
        F.col("at").alias(part), "filter_order", "step", (zero("here") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"),
        "unique_fails", *[zero(f"lost_{m}").alias(f"lost_{m}") for m in marks], "shapley",
    )


def first_of_copies(rows: DataFrame, key: str, *same: str) -> DataFrame:
    """rows with a last column ``copy``: whether a smaller key has the same values. rows is a stored table."""
    groups = rows.groupBy(*[F.col(c).alias("c_" + c) for c in same]).agg(F.min(key).alias("c_least"), F.count("*").alias("c_n")).where("c_n > 1")
    on = F.lit(True)
    for c in same:
        on &= F.col(c) == F.col("c_" + c)
    met = keyed_join(rows, materialize(groups), on, "c_n", "left")
    return met.select(*rows.columns, F.coalesce(F.col(key) > F.col("c_least"), F.lit(False)).alias("copy"))


def labelled(rows: DataFrame, labels: DataFrame, key: str, **marks: Column) -> DataFrame:
    """rows with a boolean for each mark that any of the key's labels has; rows without a key are not shuffled."""
    l_key = f"l_{key}"
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(l_key)).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(m) for m, c in marks.items()])
    some = rows.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col(l_key), "left").select(*rows.columns, *[F.coalesce(m, F.lit(False)).alias(m) for m in marks])
    return some.unionByName(rows.where(F.col(key).isNull()).select("*", *[F.lit(False).alias(m) for m in marks]))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A stored table (part, A to E, good, toxic) of op13's filters and labels."""
    t = F.coalesce(docs["text"], F.lit(""))
    # Cut first, so that only the words lie between separators.
    words = F.when(F.regexp_like(t, F.lit(f"[^{SPACE}]")), F.split(F.regexp_replace(t, f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))
    n = F.size("words")
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), t.alias("t"), words.alias("words"))
    base = texts.select(
        "doc_id", "part",
        (n < 200).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * n).alias("B"),
        (100 * F.regexp_count("t", F.lit("[A-Z]")) > 3 * F.length("t")).alias("C"), F.regexp_like("t", F.lit("[#$%&*|]")).alias("D"),
        F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"),
    )
    copies = first_of_copies(materialize(base), "doc_id", "h1", "h2").withColumnRenamed("copy", "E")
    out = labelled(copies, labels, "doc_id", good=F.col("quality") == 1, toxic=F.col("toxic") == 1)
    return materialize(out.select("part", *"ABCDE", "good", "toxic"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op13: the audit of five filters over all orders."""
    return audit(flags(docs, labels), "ABCDE", "part", ["good", "toxic"]).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


ORACLE = rf"""
with text as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') as words from documents
), least as (
  select t, min(doc_id) as first from text group by t
), label as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by 1
), flag as (
  select x.part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_extract_all(x.t, '[A-Z]')) > 3 * length(x.t),
    regexp_matches(x.t, '[#$%&*|]'), coalesce(x.doc_id > l.first, false)] as fails, coalesce(b.good, false) as good, coalesce(b.toxic, false) as toxic
  from text x join least l on x.t = l.t left join label b on x.doc_id = b.doc_id
), pattern as (
  select part, fails, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from flag group by 1, 2
), letter(f) as (
  values (1), (2), (3), (4), (5)
), orders as (
  select [a.f, b.f, c.f, d.f, e.f] as o from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
  select o, unnest([1, 2, 3, 4, 5])::int as step from orders
), part as (
  select distinct part from flag
), counted as (
  select p.part, s.o, s.step,
    coalesce(sum(n) filter (where not list_bool_or(list_transform(s.o[:s.step], lambda f: fails[f]))), 0)::bigint as kept,
    coalesce(sum(n) filter (where fails[s.o[s.step]] and not coalesce(list_bool_or(list_transform(s.o[:s.step - 1], lambda f: fails[f])), false)), 0)::bigint as removed,
    coalesce(sum(n) filter (where fails[s.o[s.step]] and list_bool_or(list_transform(s.o[:s.step - 1], lambda f: fails[f]))), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails[s.o[s.step]] and len(list_filter(fails, lambda x: x)) = 1), 0)::bigint as unique_fails,
    coalesce(sum(g.good) filter (where fails[s.o[s.step]] and not coalesce(list_bool_or(list_transform(s.o[:s.step - 1], lambda f: fails[f])), false)), 0)::bigint as good_lost,
    coalesce(sum(g.toxic) filter (where fails[s.o[s.step]] and not coalesce(list_bool_or(list_transform(s.o[:s.step - 1], lambda f: fails[f])), false)), 0)::bigint as toxic_lost
  from part p cross join steps s join pattern g on g.part = p.part group by 1, 2, 3
)
select part, array_to_string(list_transform(o, lambda f: substr('ABCDE', f, 1)), '') as filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, o[step])::bigint as shapley
from counted
"""

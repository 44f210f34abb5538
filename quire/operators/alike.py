"""Documents that say the same are worked on once.

A paragraph's own facts depend on its text and format: each distinct text is read once. What follows from a document's
order depends on the facts of its paragraphs alone: each distinct sequence of facts is worked on once, and its results go to all
documents that have it. On texts that are all different this costs a shuffle of the texts and one of the documents more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import stored

FREQUENT = 20_000  # rows that may be broadcast


def looked_up(rows: DataFrame, values: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows with the other columns of values, a stored table with one row for each value of ``on`` in rows; n: its column that tells how often. Nulls are equal.

    The most frequent values are broadcast, so no key of the shuffle is hot; the others are joined by merge, as their size in
    memory is far above that of their files, by which Spark would decide.
    """
    edge = values.select(n).orderBy(F.desc(n)).limit(FREQUENT + 1).agg(F.count("*"), F.min(n)).first()
    values = values.withColumnsRenamed({x: f"of_{x}" for x in on})
    same = reduce(and_, (F.col(x).eqNullSafe(F.col(f"of_{x}")) for x in on))
    gone = [n, *(f"of_{x}" for x in on)]
    if edge[0] <= FREQUENT:
        return rows.join(F.broadcast(values), same).drop(*gone)
    hot, cold = values.where(F.col(n) > edge[1]), values.where(F.col(n) <= edge[1])  # at most FREQUENT rows are above the edge
    rest = rows.join(F.broadcast(hot.select(*gone[1:])), same, "left_anti").join(cold.hint("merge"), same)
    return rows.join(F.broadcast(hot), same).unionByName(rest).drop(*gone)


class Alike(NamedTuple):
    """docs: (doc_id, at, kinds), the places and kinds of a document's paragraphs in order; classes: (kinds, doc_id, documents), distinct
    sequences with numbers of their own; rows: (doc_id, documents, pos, facts), their paragraphs."""

    docs: DataFrame
    classes: DataFrame
    rows: DataFrame

    def to_documents(self, found: DataFrame) -> DataFrame:
        """found, one row for each class (doc_id), for all its documents."""
        of = self.classes.select("kinds", F.col("doc_id").alias("like")).join(found.withColumnRenamed("doc_id", "like").hint("merge"), "like").drop("like")
        return self.docs.join(of.hint("merge"), "kinds").drop("kinds")

    def to_paragraphs(self, found: DataFrame) -> DataFrame:
        """found (doc_id, pos, ...), one row for each paragraph of a class, for all paragraphs of its documents."""
        more = [x for x in found.columns if x not in ("doc_id", "pos")]
        whole = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", *more))).alias("found"))
        both = F.zip_with("at", "found", lambda at, x: F.struct(at.alias("pos"), *[x[n].alias(n) for n in more]))
        return self.to_documents(whole).select("doc_id", F.inline(both))


def alike(paragraphs: DataFrame, facts: Callable[..., DataFrame]) -> Alike:
    """The classes of documents (doc_id, pos, ...) whose paragraphs have the same facts in the same order.

    facts(paragraphs, **columns) gives a row's own facts and the columns named. A document is one row of places and numbers.
    """
    said = [x for x in paragraphs.columns if x not in ("doc_id", "pos")]
    texts = paragraphs.groupBy(*said).agg(F.count("*").alias("times")).withColumns({"doc_id": F.lit(0), "pos": F.lit(0), "said": F.struct(*said)})
    read = stored(facts(texts, said=F.col("said"), times=F.col("times")).drop("doc_id", "pos"))
    own = [x for x in read.columns if x not in ("said", "times")]
    kinds = stored(read.groupBy(*own).agg(F.sum("times").alias("times"), F.count("*").alias("texts")).withColumn("kind", F.monotonically_increasing_id()))
    named = stored(looked_up(read, kinds.drop("times"), own, "texts").select("said.*", "kind", "times"))
    placed = looked_up(paragraphs, named, said, "times").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "kind"))).alias("x"))
    docs = stored(placed.select("doc_id", F.col("x.pos").alias("at"), F.col("x.kind").alias("kinds")))
    classes = stored(docs.groupBy("kinds").agg(F.count("*").alias("documents")).withColumn("doc_id", F.monotonically_increasing_id()))
    rows = looked_up(classes.select("doc_id", "documents", F.posexplode("kinds").alias("pos", "kind")), kinds.drop("texts"), ["kind"], "times")
    return Alike(docs, classes, rows)

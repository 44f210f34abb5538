"""Language identification by bit-sliced Bloom filters of character n-grams (op10).

Training takes a bounded sample of labelled rows (``fit_rows`` per language in
expectation, chosen by a hash of the id), four fifths of which teach: a Spark
aggregation finds every n-gram of each language, and every language that has an n-gram is a member of
it, however rare it is there. All languages share one array of slots; a slot holds one bit per language, as many bytes as they
need, so the AND of an n-gram's slots is the set of all languages containing it. There are eight slots for each n-gram, up to
``max_slots``; beyond, all n-grams still teach, and more of them share slots. The tasks of a
Spark aggregation fill the array in blocks of ``BLOCK`` slots; no n-grams reach the driver.
A text's hits are counted per language, every count is corrected for that
language's measured false-positive rate, and the largest decides.

The last fifth of the sample sets a least score for each language, ``MARGIN`` times the
``LOW`` quantile of its scores: ``keep`` takes a text below it for none of the learned languages.

Edge cases: a text that is null or has no letter is ``und`` with score 0. Ties go
to the language that sorts first, and so does a text that shares nothing with any language, with score 0. Rows with a null language or id teach nothing.
With no training rows every text is ``und``. Texts of any length are read whole.
Repeated rows count as often as they occur. Columns other than those named are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced

N, HASHES, UND = 4, 3, "und"
LOW, MARGIN, TEACH = 0.01, 0.5, 0.8
BLOCK = 4096
SPACE = np.uint32(32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a lower-cased text whose other characters are one space each run; each has a letter."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[cp]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    cp = np.where(is_letter, cp, SPACE)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    cp = cp[keep].astype(np.uint64)
    if len(cp) < N:
        cp = np.concatenate([cp, np.full(N - len(cp), 32, np.uint64)])
    h = cp[: len(cp) - N + 1].copy()
    for i in range(1, N):
        h = h * np.uint64(0x100000001B3) + cp[i : len(cp) - N + 1 + i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of each hash in an array whose size is a power of two."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    languages: list[str]
    filters: np.ndarray  # one row of bytes per slot, one bit per language
    false_positive: np.ndarray
    least: np.ndarray  # per language, the score below which a text is in none

    def classify(self, text: str | None) -> tuple[str, float]:
        best, score = self.best(text)
        return (UND, 0.0) if best is None else (self.languages[best], score)

    def best(self, text: str | None) -> tuple[int | None, float]:
        """The language's number, None for a text without letters, and the score."""
        h = grams(text or "")
        if not len(h) or not self.languages:
            return None, 0.0
        hits = np.zeros(len(self.languages))
        for i in range(0, len(h), 1 << 16):
            a, *others = slots(h[i : i + (1 << 16)], len(self.filters))
            found = self.filters[a]
            for place in others:
                found &= self.filters[place]
            if found.shape[1] == 1:
                hits += [np.count_nonzero(found & np.uint8(1 << k)) for k in range(len(hits))]
            else:
                hits += np.unpackbits(found, axis=1, count=len(hits), bitorder="little").sum(0)
        share = np.clip((hits / len(h) - self.false_positive) / (1 - self.false_positive), 0, 1)
        best = int(np.argmax(share))
        return best, float(share[best])

    def knows(self, text: str | None) -> bool:
        best, score = self.best(text)
        return best is not None and score > 0 and score >= self.least[best]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = 2500, max_slots: int = 1 << 24) -> Model:
    """Fit on about ``fit_rows`` rows per language.

    What reaches the driver is bounded by the parameters: one row per language and
    the filters, a bit per language in at most ``max_slots`` slots.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("key is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0), np.zeros(0))
    index = {x: i for i, x in enumerate(languages)}
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = rows.sparkSession.createDataFrame([(x, i, min(1.0, fit_rows / counts[x])) for x, i in index.items()], "known string, number int, rate double")
    sample = rows.join(F.broadcast(rates), F.col("lang") == F.col("known")).where(part < F.col("rate")).select("text", "number", (part >= TEACH * F.col("rate")).alias("aside"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for t, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(i, []).append(grams(t))
            for i, own in by.items():
                h = np.unique(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i, np.int32))], ["gram", "lang"])

    seen = materialize(sample.where("not aside").select("text", "number").mapInArrow(found, "gram long, lang int").distinct())
    size = min(max_slots, 1 << max(10, int(np.ceil(np.log2(max(1, seen.select(F.approx_count_distinct("gram", 0.01)).first()[0]) * 8)))))
    filters = np.zeros((size, -(-len(languages) // 8)), np.uint8)
    for r in filled(seen, size, filters.shape[1]).collect():
        own = np.frombuffer(r["bits"], np.uint8).reshape(-1, filters.shape[1])
        filters[r["block"] * BLOCK : r["block"] * BLOCK + len(own)] = own
    fill = np.array([np.count_nonzero(filters[:, i // 8] & np.uint8(1 << i % 8)) / size for i in range(len(languages))])
    model = Model(languages, filters, fill**HASHES, np.zeros(len(languages)))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.best(t) for t in batch.column(0).to_pylist()]
            right = [s if b == i else None for (b, s), i in zip(found, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(right, pa.float64())], ["number", "score"])

    scored = sample.where("aside").select("text", "number").mapInArrow(score, "number int, score double").where("score is not null")
    for r in scored.groupBy("number").agg(F.percentile_approx("score", LOW, 10_000).alias("low")).collect():
        model.least[r["number"]] = MARGIN * r["low"]
    return model


def filled(seen: DataFrame, size: int, width: int) -> DataFrame:
    """(block, bits): the filters' bytes in blocks of BLOCK slots, from n-grams (gram, lang). A task holds one block."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(slots(batch.column(0).to_numpy().view(np.uint64), size))
            lang = np.tile(batch.column(1).to_numpy(), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK).astype(np.int32)), pa.array(lang)], ["block", "at", "lang"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((min(BLOCK, size), width), np.uint8)
        at, lang = pdf["at"].to_numpy(), pdf["lang"].to_numpy()
        np.bitwise_or.at(out, (at, lang // 8), (1 << lang % 8).astype(np.uint8))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [out.tobytes()]})

    return seen.mapInArrow(places, "block int, at int, lang int").distinct().groupBy("block").applyInPandas(fill, "block int, bits binary")


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row; score is the corrected share of the text's n-grams that the language knows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [shared.value.classify(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether the CRC-32 of the id's decimal text leaves 0 when divided by 5; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """op10: learn from the rows that are not held out, predict every row."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are in one of the learned languages."""
    schema, where = docs.schema, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([shared.value.knows(t) for t in batch.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)

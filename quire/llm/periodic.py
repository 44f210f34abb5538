"""Periodic runs of words by a harmonic grid and prefix hashes (op11).

A run is a stretch of consecutive words with smallest period q, of at least
``max(least, exponent * q)`` words, that no neighbour extends. Its pairs of equal words
q apart are at least ``(exponent - 1) * q`` in a row, so one of them starts on the grid
of that step: over all periods the grid has n log n points. For all (period, grid point)
pairs at once, NumPy binary searches over prefix hashes find how far the equality goes on
to both sides (the longest common extensions).

Results are exact. Extensions by hashes are never too short; each found stretch is
verified word by word, and its other periods must be multiples of its smallest, as the
theorem of Fine and Wilf demands. Where either fails, the text is searched anew with
other hashes.

Edge cases: a null text has no words. Texts of any length are searched whole, the pairs in
blocks of ``BLOCK``. Rows stand for themselves, so repeated rows and ids repeat results. A
null id is kept. Extra columns pass through ``collapse``; empty tables give none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SEED, bytes_of

LEAST, EXPONENT, BLOCK = 6, 4, 1 << 18
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


class Hashes:
    """Prefix sums of word values times powers of a base, modulo two primes."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng([SEED, seed])
        self.parts = []
        for prime in PRIMES:
            p, base = np.uint64(prime), int(rng.integers(1 << 20, prime))
            power = np.ones(1, np.uint64)
            while len(power) <= len(ids):
                power = np.concatenate([power, power * np.uint64(pow(base, len(power), prime)) % p])
            value = rng.integers(1, prime, int(ids.max()) + 1).astype(np.uint64)[ids]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(ids)] % p) % p])
            self.parts.append((p, power, total))

    def equal(self, i: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i are those from i + q."""
        out = np.ones(len(i), bool)
        for p, power, total in self.parts:
            a, b = total[i + n] + p - total[i], total[i + q + n] + p - total[i + q]
            out &= a % p * power[q] % p == b % p
        return out

    def extend(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The greatest number of words, at most ``most``, that are equal from i on (or before i) and q later."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            hit = self.equal(i - mid if back else i, q, mid)
            low, high = np.where(hit, mid, low), np.where(hit, high, mid - 1)
        return low


def _met(ids: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) pairs at which equality of words q apart may go on, in blocks."""
    n, widest = len(ids), len(ids) // exponent
    periods = np.arange(1, widest + 1)
    last = np.cumsum((n - periods - 1) // (periods * (exponent - 1)) + 1) if widest else np.zeros(0, np.int64)
    for at in range(0, int(last[-1]) if widest else 0, BLOCK):
        k = np.arange(at, min(at + BLOCK, int(last[-1])))
        row = np.searchsorted(last, k, "right")
        q = periods[row]
        i = (k - np.where(row > 0, last[row - 1], 0)) * q * (exponent - 1)
        same = np.flatnonzero(ids[i] == ids[i + q])
        i, q = i[same], q[same]
        # A run has more equal pairs in a row than these three: two after the point, two before, or one on either side.
        a, b, c, d = ((i + by >= 0) & (i + q + by < n) & (ids[np.clip(i + by, 0, n - 1)] == ids[np.clip(i + q + by, 0, n - 1)]) for by in (-2, -1, 1, 2))
        near = np.flatnonzero((a & b) | (b & c) | (c & d))
        if len(near):
            yield i[near], q[near]


def _search(ids: np.ndarray, least: int, exponent: int, seed: int) -> np.ndarray | None:
    """(start, end, period) rows, or None where the hashes of this seed took different words for equal."""
    hashes, found = None, []
    for i, q in _met(ids, exponent):
        hashes = hashes or Hashes(ids, seed)
        end = i + q + hashes.extend(i, q, len(ids) - i - q, False)
        start = i - hashes.extend(i, q, i, True)
        long = end - start >= np.maximum(least, exponent * q)
        found.append(np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    if not len(rows):
        return rows
    # Sorted by start, end and period: the first of a stretch has its smallest period.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    runs = rows[first]
    if (rows[:, 2] % runs[np.cumsum(first) - 1, 2]).any():
        return None
    for start, end, q in runs.tolist():
        if (ids[start : end - q] != ids[start + q : end]).any():
            return None
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find(words: list, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, end, period) of every run of a word list, by start, then period. exponent is at least 3, least at least 5."""
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    seed, runs = 0, None
    while runs is None:
        runs, seed = _search(ids, least, exponent, seed), seed + 1
    return runs


def kept(words: list, runs: np.ndarray) -> list:
    """The words that stay: of a run only its first period does, unless another run drops that too."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def strongest(runs: np.ndarray) -> tuple | None:
    """(start, length, period) of the run with the greatest exact length / period; the first of equals."""
    best = None
    for start, end, q in runs.tolist():
        if best is None or (end - start) * best[2] > best[1] * q:
            best = (start, end - start, q)
    return best


def _mapped(docs: DataFrame, text: str, key: str, row: Callable, columns: str) -> DataFrame:
    """key and the columns that row(key, text) lists, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, at = batch.column(0), [], []
            for k, (i, t) in enumerate(zip(keys.to_pylist(), batch.column(1).to_pylist())):
                found = row(i, t)
                rows += found
                at += [k] * len(found)
            values = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(v, k) for v, k in zip(values, kinds))], names=[key, *names])

    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in columns.split(", ")]
    kind = docs.schema[key].dataType.simpleString()
    # Names of the caller's columns may clash with those of the result.
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, {columns}")


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, length, period): one row for each run, in words from 0."""

    def row(_, t: str | None) -> list[tuple]:
        return [(s, e - s, q) for s, e, q in find(bytes_of(t).split()).tolist()]

    return _mapped(docs, text, key, row, "start long, length long, period long")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every run cut to its first period; texts without a run stay as they are, others are joined by single spaces."""
    where, schema = docs.columns.index(text), docs.schema

    def one(t: str | None) -> str | None:
        words = bytes_of(t).split()
        runs = find(words)
        return b" ".join(kept(words, runs)).decode() if len(runs) else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([one(t) for t in batch.column(where).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([out if i == where else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def planted(key: object, words: list) -> list:
    """The words of op11's contract: every tenth document repeats a stretch of its own."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """op11: the number of runs, the strongest, and digests of all runs and of the collapsed text."""

    def row(i: object, t: str | None) -> list[tuple]:
        words = planted(i, bytes_of(t).split())
        runs = find(words)
        best = strongest(runs) or (None, None, None)
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
        digests = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(kept(words, runs)))]
        return [(len(runs), *best, 1000 * best[1] // best[2] if best[2] else None, *digests)]

    return _mapped(docs, text, key, row, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

"""BPE encoding and decoding by the contiguous rank array (op8).

A word (one match of the pre-tokenizer pattern) starts as one part per byte. Two
flat arrays hold the part boundaries and the merge rank of every adjacent pair.
The smallest rank is found by a scan, its boundary is deleted, and only the ranks
of the two neighbouring pairs are looked up again. Scanning is quadratic, so words
over ``SHORT`` bytes keep the same state in a linked list with a heap. Encoded
words are kept in a per-worker table of bounded size.

Edge cases: a null or empty text has no tokens and decodes to the empty text.
Special tokens found in a text become their own id, as the tokenizers library does
with add_special_tokens=False. Rows are independent, so repeated rows, empty
tables and extra columns need no care; extra columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT, CACHED = 160, 250_000
NONE = 1 << 60
# Fixed value: the published split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# The same split in the standard library's terms. There \w holds numbers that are no decimal digits and \s the
# information separators, so it serves texts without those.
PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def splitter() -> Callable[[str], list[str]]:
    """A function from a text to its words; texts beyond Latin, or with one of those characters, take the exact pattern."""
    find_odd, plain, exact = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search, PLAIN.findall, regex.compile(PATTERN).findall
    return lambda text: exact(text) if find_odd(text) else plain(text)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Words(dict):
    """word -> token ids; a missing word is encoded, and a full table starts anew."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        ids = tuple(self.bpe.encode_word(word.encode("utf-8", "replace")))
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [vocab[s] for s in symbols]
        value = {s: b for b, s in enumerate(symbols)}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(value[c] for c in s)
        for s, i in special.items():
            self.token[i] = s.encode()
        self.text_of_id = [str(i) for i in range(size)]
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words_of = splitter()
        self.cache = Words(self)

    def encode_word(self, word: bytes) -> list[int]:
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        get = self.ranks.get
        parts = [self.byte_id[b] for b in word]
        bounds = list(range(len(word) + 1))
        ranks = [get(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del bounds[i + 1], parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NONE)
        assert len(parts) == len(bounds) - 1
        return parts

    def _long(self, word: bytes) -> list[int]:
        get, parts, n = self.ranks.get, [self.byte_id[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]), NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((parts[i], parts[k]), NONE)) < NONE:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := get((parts[h], parts[i]), NONE)) < NONE:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        if self.split is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.cache.__getitem__, self.words_of(text))))
        ids: list[int] = []
        for piece in self.split.split(text):
            ids += [self.special[piece]] if piece in self.special else chain.from_iterable(map(self.cache.__getitem__, self.words_of(piece)))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of every row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(F.col(key).alias("key"), F.col(ids)).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every text in one pass; only digests of ids and of the decoded text leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(bpe.text_of_id.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string"))
    return out.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)

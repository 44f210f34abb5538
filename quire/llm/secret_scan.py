"""Secret scanning with one combined deterministic automaton (op6).

All rules, whole, are parsed into one NFA, made deterministic by subset construction
over byte classes and minimised by partition refinement; the result is one flat array
of transitions. One pass over the bytes of a text advances one state and reports
every (rule, position) at which a match of a rule can first end. A report is turned into a span by two
small automata of its rule, made in the same way: the reversed one walks back to the leftmost
start behind the rule's last span, the anchored one walks on to the longest end, which gives leftmost,
non-overlapping matches in the whole text. Bytes outside spans are read once. The
automata are built on the driver and shared.

A report may come from a start inside the last span of its rule; then no start is found and
the rule's own unanchored automaton goes on from that span's end to its next possible end, so
no stretch is walked twice.

Texts are scanned with one byte per code point (all rules are ASCII; others become
'?'-like bytes outside every rule), so positions are code points.

Edge cases: a null or empty text has no spans. Positions count code points, end
exclusive. Overlapping spans of different kinds are all reported. A match whose
secret is shorter than ``least`` is dropped, but what it covers is not searched again by its rule. Repeated rows
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

B64 = "A-Za-z0-9+/_.=-"


@dataclass(frozen=True)
class Rule:
    """pattern: the whole rule, of literals, sets, groups, alternatives and repeats; lead: the part of it before the secret, of which least characters are needed.

    The first report of a match must come no later than that of any match that starts inside its shortest form.
    """

    kind: str
    pattern: str
    least: int = 0
    lead: str = ""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "(?:" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + ")"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?"""
_GAP = r"(?:[\x20\t\r\n]|\\[rnt])"
_HEADER = r"[A-Za-z][A-Za-z-]*: ?[A-Za-z0-9,-]+"
_LABEL = r"(?:[A-Z]+ ){0,2}PRIVATE KEY(?: BLOCK)?-----"
# From BEGIN to END; without END over the base64 lines that follow and the padded one that may end them.
PEM = (
    rf"-----BEGIN {_LABEL}(?:(?:{_GAP}+(?:{_HEADER}|[A-Za-z0-9+/=]+))*{_GAP}*-----END {_LABEL}"
    rf"|(?:{_GAP}+{_HEADER})*(?:{_GAP}+[A-Za-z0-9+/]{{16}}[A-Za-z0-9+/=]*)+(?:{_GAP}+[A-Za-z0-9+/]+=+)?|)"
)
# The base rules, then token formats published by their issuers.
RULES = (
    Rule("assign", ASSIGN + f"[{B64}]+", 8, ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32}[0-9a-f]*", 32),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", PEM),
)
BASE = ("assign", "access", "hex")


class Nfa:
    """States with byte-set edges and empty edges, built by reading an expression left to right."""

    def __init__(self, backwards: bool = False) -> None:
        self.backwards = backwards
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, tree, start: int) -> int:
        """Add the parsed expression behind start; the state at its end. Backwards, its parts come in reverse order."""
        for op, arg in reversed(tree) if self.backwards else tree:
            name = str(op)
            if name == "MAX_REPEAT":
                least, most, body = arg
                for _ in range(least):
                    start = self.build(body, start)
                if most == re._constants.MAXREPEAT:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.build(body, loop)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[start].append(end)
                        start = self.build(body, start)
                    self.empty[start].append(end)
                    start = end
            elif name == "BRANCH":
                end = self.state()
                for body in arg[1]:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[self.build(body, first)].append(end)
                start = end
            elif name == "SUBPATTERN":
                start = self.build(arg[3], start)
            else:
                end = self.state()
                self.edges[start].append((self.bytes_of(name, arg), end))
                start = end
        return start

    @staticmethod
    def bytes_of(name: str, arg) -> frozenset[int]:
        if name == "LITERAL":
            return frozenset([arg])
        if name != "IN":
            raise ValueError(f"not supported in a core: {name}")
        out: set[int] = set()
        for kind, value in arg:
            out |= {value} if str(kind) == "LITERAL" else set(range(value[0], value[1] + 1))
        return frozenset(out)


class Automaton:
    """The minimal deterministic automaton that reports where any pattern ends.

    anchored: patterns start where the walk starts; otherwise anywhere behind it.
    backwards: it reads the text from right to left.
    """

    def __init__(self, patterns: list[str], anchored: bool = False, backwards: bool = False):
        nfa = Nfa(backwards)
        root = nfa.state()
        ends: dict[int, set[int]] = {}
        for i, pattern in enumerate(patterns):
            first = nfa.state()
            nfa.empty[root].append(first)
            ends.setdefault(nfa.build(re._parser.parse(pattern), first), set()).add(i)
        self._determine(nfa, root, ends, anchored)

    @classmethod
    def first_ends(cls, parts: list[Automaton]) -> Automaton:
        """Reports, for a match of each anchored part anywhere, the end of its shortest form: accepting states have no exits."""
        nfa, ends = Nfa(), {}
        root = nfa.state()
        for i, part in enumerate(parts):
            spans = [frozenset(b for b in range(256) if part.classes[b] == c) for c in range(part.width)]
            states = [nfa.state() for _ in range(part.states)]
            nfa.empty[root].append(states[part.start // part.width])
            for j, state in enumerate(states):
                if j >= part.quiet:
                    ends[state] = {i}
                    continue
                for c, to in enumerate(part.next[j * part.width : (j + 1) * part.width]):
                    if to != part.dead:
                        nfa.edges[state].append((spans[c], states[to // part.width]))
        out = cls.__new__(cls)
        out._determine(nfa, root, ends, False)
        return out

    def _determine(self, nfa: Nfa, root: int, ends: dict[int, set[int]], anchored: bool) -> None:
        sets = {s for edges in nfa.edges for s, _ in edges}
        kinds: dict[tuple, int] = {}
        self.classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        example = {c: b for b, c in reversed(list(enumerate(self.classes)))}

        def closed(states: set[int]) -> frozenset[int]:
            stack = list(states)
            while stack:
                for t in nfa.empty[stack.pop()]:
                    if t not in states:
                        states.add(t)
                        stack.append(t)
            return frozenset(states)

        reached = [[closed({t}) for _, t in edges] for edges in nfa.edges]
        passes = [[[bs for bs, _ in edges][k] for k in range(len(edges))] for edges in nfa.edges]
        start = closed({root})
        again = frozenset() if anchored else start
        number, order, table = {start: 0}, [start], []
        for states in order:
            moves = [(bs, to) for s in states for bs, to in zip(passes[s], reached[s])]
            row = []
            for c in range(len(example)):
                to = again.union(*[t for bs, t in moves if example[c] in bs])
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            table.append(row)
        accepts = [frozenset(i for s in states for i in ends.get(s, ())) for states in order]
        self.width = len(example)
        self._minimise(table, accepts)
        self.dead = next((i * self.width for i in range(self.quiet) if set(self.next[i * self.width : (i + 1) * self.width]) == {i * self.width}), -1)

    def _minimise(self, table: list[list[int]], accepts: list[frozenset[int]]) -> None:
        """Moore's refinement: split blocks until equal states go to equal blocks."""
        names: dict = {}
        block = [names.setdefault(a, len(names)) for a in accepts]
        while True:
            names = {}
            finer = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(table)]
            if len(names) == len(set(block)):
                break
            block = finer
        # Quiet states come first, so that a state's number tells whether it reports.
        seen = sorted(set(block), key=lambda b: (bool(accepts[block.index(b)]), b != block[0], b))
        place = {b: i for i, b in enumerate(seen)}
        first = {place[b]: block.index(b) for b in seen}
        self.states = len(seen)
        self.quiet = sum(not accepts[first[i]] for i in range(self.states))
        self.reports = [sorted(accepts[first[i]]) for i in range(self.states)]
        self.next = [place[block[t]] * self.width for i in range(self.states) for t in table[first[i]]]
        self.start = place[block[0]] * self.width

    def scan(self, data: bytes) -> list[tuple[int, int]]:
        """(pattern, position after its last byte), in one pass over the bytes."""
        out, state, step, loud = [], self.start, self.next, self.quiet * self.width
        for i, c in enumerate(data.translate(self.classes), 1):
            state = step[state + c]
            if state >= loud:
                out += [(r, i) for r in self.reports[state // self.width]]
        return out

    def longest(self, data: bytes, at: int, to: int) -> int:
        """The farthest end of a match that starts at a place, walking towards another; -1 without one."""
        state, step, loud, classes, dead = self.start, self.next, self.quiet * self.width, self.classes, self.dead
        found, way = (at if state >= loud else -1), (1 if to >= at else -1)
        for i in range(at, to, way):
            state = step[state + classes[data[i if way > 0 else i - 1]]]
            if state >= loud:
                found = i + way
            elif state == dead:
                break
        return found

    def first(self, data: bytes, at: int) -> int:
        """The first end of a match behind a place; beyond the text without one."""
        state, step, loud, classes = self.start, self.next, self.quiet * self.width, self.classes
        for i in range(at, len(data)):
            state = step[state + classes[data[i]]]
            if state >= loud:
                return i + 1
        return len(data) + 1


class Scanner:
    """The combined automaton and the small ones of each rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.kinds = [r.kind for r in rules]
        self.least = [r.least for r in rules]
        self.back = [Automaton([r.pattern], anchored=True, backwards=True) for r in rules]
        self.on = [Automaton([r.pattern], anchored=True) for r in rules]
        self.all = Automaton.first_ends(self.on)
        self.next = [Automaton([r.pattern]) for r in rules]
        self.lead = [Automaton([r.lead], anchored=True) if r.lead else None for r in rules]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule number, end) of every match, sorted."""
        if not text:
            return []
        data, spans = text.encode("latin-1", "replace"), []
        done, wait = [0] * len(self.kinds), [0] * len(self.kinds)
        a = self.all
        state, step, loud, width, reports = a.start, a.next, a.quiet * a.width, a.width, a.reports
        for i, c in enumerate(data.translate(a.classes), 1):
            state = step[state + c]
            if state >= loud:
                for r in reports[state // width]:
                    if i > wait[r]:
                        start = self.back[r].longest(data, i, done[r])
                        if start < 0:
                            wait[r] = self.next[r].first(data, done[r]) - 1
                            continue
                        done[r] = wait[r] = end = self.on[r].longest(data, start, len(data))
                        secret = self.lead[r].longest(data, start, end) if self.lead[r] else start
                        if end - secret >= self.least[r]:
                            spans.append((start, r, end))
        return sorted(spans)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of every match, sorted."""
    return scanner(rules).find(text)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans array<struct<kind,start,end>>) of every row."""

    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in shared.value.find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["key", "spans"])

    of = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {of}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every column of docs, each text with its secrets replaced by a mark; overlapping spans are replaced once."""
    schema = docs.schema
    where = schema.names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def clean(value: str | None) -> str | None:
        spans = shared.value.find(value)
        if not spans:
            return value
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [value[at:a], mark]
            at = max(at, b)
        return "".join(out) + value[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            column = pa.array([clean(t) for t in batch.column(where).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == where else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame) -> DataFrame:
    """op6: counts of the base kinds, a digest of the base spans, and all spans as text."""
    spans = scan(docs)

    def joined(column: F.Column) -> F.Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


__all__ = ["RULES", "Rule", "Automaton", "digest", "find", "redact", "scan"]

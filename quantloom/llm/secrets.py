"""Secret scans by one combined deterministic automaton.

The rules are parsed into an NFA, determinised over byte classes by subset construction
and minimised by partition refinement into a transition array; one pass over a text's UTF-8
bytes then runs all rules at once. The array marks where some rule's match ends. At such an
end the rule's reversed automaton, built the same way, walks back to the leftmost start
that lies behind the rule's last match, which gives leftmost, longest, non-overlapping
matches for each rule. Matches failing the rule's least length are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """least: bytes of the match; after ``head``, the match's first part, rest_least more."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    rest_least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_HEAD = f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?"
#: The base rules and the formats of well-known public credentials. The run of
#: 24 hex digits is spelled out so that the automaton does not report every letter a to f.
BASE = (
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", head=_HEAD, rest_least=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]" * 24 + "[0-9a-f]*", least=24),
)
EXTRA = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _NFA:
    """Thompson construction of: literals, \\xHH and escapes, classes, groups, | ? * +."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def add(self, tree: tuple, backwards: bool) -> tuple[int, int]:
        kind, *args = tree
        if kind == "set":
            a, b = self.state(), self.state()
            self.arcs[a].append((args[0], b))
        elif kind == "cat":
            a = b = self.state()
            for part in reversed(args[0]) if backwards else args[0]:
                c, d = self.add(part, backwards)
                self.eps[b].append(c)
                b = d
        elif kind == "alt":
            a, b = self.state(), self.state()
            for part in args[0]:
                c, d = self.add(part, backwards)
                self.eps[a].append(c)
                self.eps[d].append(b)
        else:  # repeat: ? * +
            a, b = self.state(), self.state()
            c, d = self.add(args[0], backwards)
            self.eps[a].append(c)
            self.eps[d].append(b)
            if kind != "+":
                self.eps[a].append(b)
            if kind != "?":
                self.eps[d].append(c)
        return a, b


def parse(pattern: str) -> tuple:
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(c)

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            tree = choice()
            at += 1
            return tree
        if pattern[at] == "[":
            at += 1
            members: set[int] = set()
            while pattern[at] != "]":
                low = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    members.update(range(low, char() + 1))
                else:
                    members.add(low)
            at += 1
            return ("set", frozenset(members))
        return ("set", frozenset({char()}))

    def chain() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            tree = one()
            while at < len(pattern) and pattern[at] in "?*+":
                tree = (pattern[at], tree)
                at += 1
            parts.append(tree)
        return ("cat", parts)

    def choice() -> tuple:
        nonlocal at
        parts = [chain()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(chain())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    return choice()


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def compile_dfa(patterns: list[str], *, search: bool, backwards: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(next state [states, 256], accepted patterns as bits, start); state 0 is dead.

    search: a match may start at any byte. backwards: of the reversed patterns.
    """
    nfa = _NFA()
    root = nfa.state()
    for k, p in enumerate(patterns):
        a, b = nfa.add(parse(p), backwards)
        nfa.eps[root].append(a)
        nfa.accept[b] = 1 << k

    keep = sum(1 << s for s in range(len(nfa.eps)) if nfa.arcs[s] or s in nfa.accept)

    def close(state: int) -> int:
        """States reachable without a byte, as bits; only those that read or accept count."""
        todo, seen = [state], 1 << state
        while todo:
            for t in nfa.eps[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        return seen & keep

    # bytes that no set tells apart form one class
    sets = list({s for arcs in nfa.arcs for s, _ in arcs})
    signature: dict[tuple[bool, ...], int] = {}
    cls = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)])
    sample = [int(np.flatnonzero(cls == k)[0]) for k in range(len(signature))]
    start = close(root)
    # what each state reads: (class, states behind it)
    moves = [[(k, reduce(or_, own)) for k, c in enumerate(sample) if (own := [close(t) for members, t in arcs if c in members])] for arcs in nfa.arcs]
    number, rows, order = {0: 0, start: 1}, [], [0, start]
    for now in order:
        if not now:
            rows.append([0] * len(sample))
            continue
        to = [start if search else 0] * len(sample)
        for s in _bits(now):
            for k, behind in moves[s]:
                to[k] |= behind
        for x in to:
            if x not in number:
                number[x] = len(order)
                order.append(x)
        rows.append([number[x] for x in to])
    step = np.array(rows)
    bits = np.array([sum({nfa.accept[s] for s in _bits(now) if s in nfa.accept}) for now in order])

    # minimise: refine the partition by accepted patterns until no step tells two states apart
    block = np.unique(bits, return_inverse=True)[1]
    while True:
        new = np.unique(np.c_[block, block[step]], axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    first = np.unique(new, return_index=True)[1]
    order_ = np.argsort(first)  # keeps the dead state first
    name = np.empty(len(first), dtype=np.int64)
    name[order_] = np.arange(len(first))
    keep = first[order_]
    return name[new[step[keep]]][:, cls], bits[keep], int(name[new[1]])


class Scanner:
    """All rules in one transition array, states times 256, accepting states last."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        step, bits, start = compile_dfa([r.pattern for r in rules], search=True)
        order = np.argsort(bits != 0, kind="stable")
        name = np.empty_like(order)
        name[order] = np.arange(len(order))
        self.start = int(name[start]) * 256
        self.array = name[step[order]].astype(np.int32)
        self.bits = bits[order].tolist()
        self.accepting = int((bits == 0).sum()) * 256
        self.back = []
        for r in rules:
            s, b, at = compile_dfa([r.pattern], search=False, backwards=True)
            self.back.append((s, b, at))
        self.head = []
        for r in rules:
            s, b, at = compile_dfa([r.head], search=False) if r.head else ([], [], 0)
            self.head.append((s, b, at))

    @cached_property
    def step(self) -> list[int]:
        """The flat transition array; equal entries share one object, so it stays small."""
        objects = [k * 256 for k in range(len(self.array))]
        return list(map(objects.__getitem__, self.array.ravel().tolist()))

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rules as bits) wherever accepting ends for some rule, in one pass."""
        step, accepting, bits = self.step, self.accepting, self.bits
        out = []
        state, had = self.start, 0
        for at, byte in enumerate(data):
            state = step[state + byte]
            if state >= accepting or had:
                now = bits[state >> 8]
                if had & ~now:
                    out.append((at, had & ~now))
                had = now
        if had:
            out.append((len(data), had))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, leftmost and non-overlapping per rule, by start then rule."""
        last = [0] * len(self.rules)
        out = []
        for end, which in self.ends(data):
            for k, rule in enumerate(self.rules):
                if not which >> k & 1:
                    continue
                step, accept, state = self.back[k]
                begin, at = -1, end
                while at > last[k] and state:
                    at -= 1
                    state = step[state][data[at]]
                    if accept[state]:
                        begin = at
                if begin < 0:
                    continue
                last[k] = end
                if end - begin >= rule.least and end - self._rest(data, begin, end, k) >= rule.rest_least:
                    out.append((begin, end, k))
        return sorted(out, key=lambda s: (s[0], s[2]))

    def _rest(self, data: bytes, begin: int, end: int, k: int) -> int:
        """Where the part after the rule's head begins: its longest match from begin."""
        step, accept, state = self.head[k]
        rest = at = begin
        while at < end and state:
            state = step[state][data[at]]
            at += 1
            if accept[state]:
                rest = at
        return rest


@cache
def scanner() -> Scanner:
    return Scanner(BASE + EXTRA)


def _listed(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def find(scan: Scanner, text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, rule) in code points, by start, then rule."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = scan.spans(data)
    if not spans or data.isascii():
        return spans
    point = np.r_[0, np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)]
    return [(int(point[a]), int(point[b]), k) for a, b, k in spans]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_list string, spans string"


def _runner(scan: Scanner):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(scan, t.as_py()) for t in batch.column(1)]
            base = [[s for s in spans if s[2] < len(BASE)] for spans in found]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
            lists = [pa.array([_listed(spans, scan.rules) for spans in x], pa.string()) for x in (base, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *lists], ["doc_id", "n_assign", "n_access", "n_hex", "base_list", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text of ``docs(doc_id, text)``, in one narrow pass.

    Null or empty texts have none (empty lists). Repeated rows stay; an empty table gives
    no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_runner(scanner()), SCHEMA).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_list", 256).alias("base_sha256"), "spans"
    )

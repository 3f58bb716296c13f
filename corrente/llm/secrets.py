"""Secret scan with one combined deterministic automaton.

The rules' regular expressions (bytes; literals, classes, groups, |, ?, *, +,
{m,n}) become one nondeterministic automaton, then a deterministic one by subset
construction, then the minimal one by partition refinement; its transitions are
one array over classes of bytes that no rule tells apart.  One pass over the
bytes of a batch recognises all rules, as a whole each.  No rule crosses a line
break, so the lines of a batch are lanes that advance in step.

Only lines in which a rule was recognised are read again, for the exact spans: a
second combined automaton, of the rules reversed, goes once from the line's end
to its start and marks where a match of each rule starts; from the leftmost mark
on, the rule's own automaton takes the longest match.  So spans are leftmost,
longest and non-overlapping per kind, and a start that leads to no match costs
nothing: the time is linear in the line for rules, such as these, that no byte
beyond a match keeps alive.

Spans count code points, end exclusive.  Rules beyond the three base ones only
add spans.  Defined results.  Nulls: a null text is empty; ids may be null or
repeat, every row is scanned by itself.  Ties: spans that start together are
ordered by kind as listed.  Very long texts and lines are read to the end.
Clashing names: kept columns stay, an added column of the same name gets an
underscore before its name.  Empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, named, over_batches
from .textscan import Chunk, chunks

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ANYCASE = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_HEAD = "(" + "|".join(map(_ANYCASE, ("password", "passwd", "secret", "token"))) + "|" + _ANYCASE("api") + "_?" + _ANYCASE("key") + ")"

#: kind, pattern, least length of a match, least length of its value; matches that are shorter are dropped.
RULES = (
    ("assign", _HEAD + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]+", 0, 8),
    ("access", "AKIA[A-Z0-9]+", 16, 0),
    ("hex", "[0-9a-f]{32,}", 32, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("slack", "xox[abprs]\\-[0-9A-Za-z\\-]+", 15, 0),
    ("google", "AIza[0-9A-Za-z_\\-]+", 39, 0),
    ("stripe", "[sr]k_live_[0-9A-Za-z]+", 24, 0),
    ("jwt", "eyJ[0-9A-Za-z_\\-]+\\.[0-9A-Za-z_\\-]+\\.[0-9A-Za-z_\\-]+", 36, 0),
    ("private_key", "\\-\\-\\-\\-\\-BEGIN [A-Z ]*PRIVATE KEY\\-\\-\\-\\-\\-", 0, 0),
)
BASE = 3


class _Nfa:
    """Thompson's construction of one pattern into shared state lists."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.p, self.i = pattern, 0
        out = self._either()
        if self.i != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.i}")
        return out

    def _either(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.state(), self.state()
        for x, y in parts:
            self.eps[a].append(x)
            self.eps[y].append(b)
        return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x, y = self._repeated()
            self.eps[b].append(x)
            b = y
        return a, b

    def _repeated(self) -> tuple[int, int]:
        at = self.i
        one = self._atom()
        text = self.p[at : self.i]
        if self.i >= len(self.p) or self.p[self.i] not in "?*+{":
            return one
        c = self.p[self.i]
        self.i += 1
        lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
        if c == "{":
            end = self.p.index("}", self.i)
            low, comma, high = self.p[self.i : end].partition(",")
            lo, hi, self.i = int(low), (int(high) if high else None) if comma else int(low), end + 1
        back = self.p, self.i

        def again() -> tuple[int, int]:
            self.p, self.i = text, 0
            return self._atom()

        a = b = self.state()
        for _ in range(lo):
            x, y = again()
            self.eps[b].append(x)
            b = y
        if hi is None:
            x, y = again()
            loop = self.state()
            self.eps[b].append(loop)
            self.eps[loop].append(x)
            self.eps[y].append(loop)
            b = loop
        else:
            ends = [b]
            for _ in range(hi - lo):
                x, y = again()
                self.eps[b].append(x)
                b = y
                ends.append(b)
            last = self.state()
            for e in ends:
                self.eps[e].append(last)
            b = last
        self.p, self.i = back
        return a, b

    def _byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def _atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            out = self._either()
            self.i += 1
            return out
        if c == "[":
            self.i += 1
            chars: set[int] = set()
            while self.p[self.i] != "]":
                lo = self._byte()
                hi = lo
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    hi = self._byte()
                chars.update(range(lo, hi + 1))
            self.i += 1
        else:
            chars = {self._byte()}
        if 10 in chars:
            raise ValueError("a rule cannot cross a line break")
        a, b = self.state(), self.state()
        self.move[a] = (frozenset(chars), b)
        return a, b


def _reversed(nfa: _Nfa) -> _Nfa:
    """All arrows turned round."""
    back = _Nfa()
    back.eps, back.move = [[] for _ in nfa.eps], [None] * len(nfa.move)
    for a, to in enumerate(nfa.eps):
        for b in to:
            back.eps[b].append(a)
    for a, m in enumerate(nfa.move):
        if m:
            # a state has one move, so one of its own takes each
            x = back.state()
            back.eps[m[1]].append(x)
            back.move[x] = (m[0], a)
    return back


class Dfa:
    """Minimal automaton.  state' = step[state * n_classes + byte_class[byte]]; start is 0; marks[state]: bits of the rules recognised there; dead: a state that none leaves, or -1."""

    def __init__(self, patterns: list[str], search: bool, backward: bool = False):
        nfa, ends = _Nfa(), {}
        roots = []
        for k, p in enumerate(patterns):
            a, b = nfa.add(p)
            a, b = (b, a) if backward else (a, b)
            roots.append(a)
            ends[b] = 1 << k
        nfa = _reversed(nfa) if backward else nfa
        sets = list({m[0] for m in nfa.move if m})
        kinds: dict[tuple[bool, ...], int] = {}
        self.byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
        sample = {c: b for b, c in enumerate(self.byte_class.tolist())}
        n_classes = self.n_classes = len(kinds)

        @functools.cache
        def reach(x: int) -> int:
            """The states that x leads to without a byte and that matter, a bit each."""
            seen, todo = {x}, [x]
            while todo:
                for y in nfa.eps[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return sum(1 << y for y in seen if nfa.move[y] or y in ends)

        moves = {y: ([c for c, b in sample.items() if b in m[0]], reach(m[1])) for y, m in enumerate(nfa.move) if m}
        start = functools.reduce(int.__or__, map(reach, roots))
        found, todo, step, marks = {start: 0}, [start], [], []
        for now in todo:
            mark, row = 0, [start if search else 0] * n_classes
            while now:
                y = (now & -now).bit_length() - 1
                now &= now - 1
                mark |= ends.get(y, 0)
                if y in moves:
                    for c in moves[y][0]:
                        row[c] |= moves[y][1]
            marks.append(mark)
            for to in row:
                if to not in found:
                    found[to] = len(found)
                    todo.append(to)
            step.append([found[to] for to in row])
        t, m = np.array(step), np.array(marks)
        # partition refinement: states of a block agree in marks and in the blocks that they step to
        block = np.unique(m, return_inverse=True)[1]
        while True:
            finer = block
            for c in range(n_classes):
                finer = np.unique(finer * len(t) + block[t[:, c]], return_inverse=True)[1]
            if finer.max() == block.max():
                break
            block = finer
        order = np.full(block.max() + 1, -1)
        # the start first, states that recognise nothing before the others
        member = np.zeros(block.max() + 1, np.int64)
        member[block[::-1]] = np.arange(len(block))[::-1]
        rank = sorted(range(len(member)), key=lambda b: (b != block[0], m[member[b]] != 0, member[b]))
        order[rank] = np.arange(len(rank))
        first = member[rank]
        self.marks = m[first]
        self.step = order[block[t[first]]]
        self.n_states = len(first)
        self.quiet = int((self.marks == 0).sum()) if self.marks[0] == 0 else 0
        stuck = [s for s in range(self.n_states) if not self.marks[s] and (self.step[s] == s).all()]
        self.dead = stuck[0] if stuck and not search else -1
        self.flat = (self.step * n_classes).astype(np.int32).ravel()

    @functools.cached_property
    def flat_list(self) -> list[int]:
        return self.flat.tolist()

    def longest(self, data: bytes, start: int) -> int:
        """The end of the longest match from a start, 0 if there is none; the automaton must not be a searching one."""
        classes, step, k, dead = self.class_list, self.flat_list, self.n_classes, self.dead * self.n_classes
        marks, s, end = self.mark_list, 0, 0
        for i in range(start, len(data)):
            s = step[s + classes[data[i]]]
            if s == dead:
                break
            if marks[s // k]:
                end = i + 1
        return end

    @functools.cached_property
    def class_list(self) -> list[int]:
        return self.byte_class.tolist()

    @functools.cached_property
    def mark_list(self) -> list[int]:
        return self.marks.tolist()

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, bits of the rules that match from there on), from the left; the automaton must be a searching one of the rules reversed."""
        classes, step, k = self.class_list, self.flat_list, self.n_classes
        marks, s, loud, out = self.mark_list, 0, self.quiet * self.n_classes, []
        for i in range(len(data) - 1, -1, -1):
            s = step[s + classes[data[i]]]
            if s >= loud:
                out.append((i, marks[s // k]))
        return out[::-1]


Automata = tuple[Dfa, Dfa, list[Dfa]]
_built: list[Automata] = []


def automata() -> Automata:
    """The combined automaton, that of the reversed rules and each rule's own, built once in a process."""
    if not _built:
        rules = [r[1] for r in RULES]
        _built.append((Dfa(rules, search=True), Dfa(rules, search=True, backward=True), [Dfa([r], search=False) for r in rules]))
    return _built[0]


def _install(tables: Automata) -> None:
    if not _built:
        _built.append(tables)


def _value_length(span: bytes) -> int:
    low = span.lower()
    i = max(len(k) for k in _KEYWORDS if low.startswith(k))
    i += span[i : i + 1] in (b'"', b"'")
    while span[i] == 0x20:
        i += 1
    i += 1
    while span[i] == 0x20:
        i += 1
    i += span[i : i + 1] in (b'"', b"'")
    return len(span) - i


#: Lanes below this number advance one after another.
_FEW = 40


def recognised(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and bits of the rules recognised of every line that has any."""
    dfa = automata()[0]
    buf, n = chunk.buf, len(chunk.buf)
    cuts = np.unique(np.concatenate((chunk.offsets, np.flatnonzero(buf == 10) + 1)))
    start, length = cuts[:-1], np.diff(cuts)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    classes, step, k, loud = dfa.byte_class[buf], dfa.flat, dfa.n_classes, dfa.quiet * dfa.n_classes
    state, bits, marks = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64), dfa.marks
    t, active = 0, len(start)
    ends = np.searchsorted(-length, -np.arange(int(length[0]) + 1 if n else 1), "left")  # lanes longer than t
    while t < len(ends) and ends[t] > _FEW:
        active = ends[t]
        s = step[state[:active] + classes[start[:active] + t]]
        state[:active] = s
        if s.max() >= loud:
            at = np.flatnonzero(s >= loud)
            bits[at] |= marks[s[at] // k]
        t += 1
    rows, mark = dfa.flat_list, marks.tolist()
    for lane in range(ends[t] if t < len(ends) else 0):
        s, seen = int(state[lane]), 0
        for c in classes[start[lane] + t : start[lane] + length[lane]].tobytes():
            s = rows[s + c]
            if s >= loud:
                seen |= mark[s // k]
        bits[lane] |= seen
    at = np.flatnonzero(bits)
    return start[at], start[at] + length[at], bits[at]


def spans(line: bytes, bits: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, rule) of the matches of the rules in bits that are long enough, in bytes."""
    _, back, own = automata()
    done = [0] * len(RULES)
    for a, some in back.starts(line):
        some &= bits
        while some:
            k = (some & -some).bit_length() - 1
            some &= some - 1
            if a >= done[k]:
                done[k] = b = own[k].longest(line, a)
                _, _, least, value = RULES[k]
                if b - a >= least and (not value or _value_length(line[a:b]) >= value):
                    yield a, b, k


def find(texts: pa.Array) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(row, [(start, end, rule)]) of the rows with spans, in code points, by start and rule."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for chunk in chunks(texts, 4 << 20):
        if not len(chunk.buf):
            continue
        points = None
        for a, b, bits in zip(*(x.tolist() for x in recognised(chunk)), strict=True):
            row = int(np.searchsorted(chunk.offsets, a, "right")) - 1
            for i, j, k in spans(chunk.buf[a:b].tobytes(), bits):
                if points is None:
                    points = np.concatenate(([0], np.cumsum((chunk.buf & 0xC0) != 0x80)))
                zero = points[chunk.offsets[row]]
                out.setdefault(chunk.first_row + row, []).append((int(points[a + i] - zero), int(points[a + j] - zero), k))
    return [(row, sorted(v, key=lambda x: (x[0], x[2], x[1]))) for row, v in sorted(out.items())]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, b, k in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def scan_secrets(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, counts of the base kinds, digest of the base spans and all spans of every row."""
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(automata())  # about 1 MB, whatever the input

    def work(texts: pa.Array) -> list[pa.Array]:
        _install(sent.value)
        counts = np.zeros((BASE, len(texts)), np.int64)
        digest, told = [_NOTHING] * len(texts), [""] * len(texts)
        for row, found in find(texts):
            for _, _, k in found:
                if k < BASE:
                    counts[k, row] += 1
            digest[row], told[row] = hashlib.sha256(joined([x for x in found if x[2] < BASE]).encode()).hexdigest(), joined(found)
        return [*map(pa.array, counts), pa.array(digest, pa.string()), pa.array(told, pa.string())]

    return over_batches(docs, keep, [named(text_col)], work, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def report(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

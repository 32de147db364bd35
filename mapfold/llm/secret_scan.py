"""Secrets in texts, found by one deterministic automaton of all rules.

Each rule is a regular expression over bytes. All rules are compiled together by subset construction into one automaton,
which is then minimised; its transitions are one array of states by classes of bytes. A text is read once, a byte a
step, for all rules; a state says which rules' matches have just ended. A match's start is found by the rule's reversed
automaton, run back from its end.

Matches of a rule are leftmost, of these the longest, and don't overlap: after a match, the rule starts anew, while the
other rules go on. Those whose tail is shorter than the rule's least are dropped after that, so they too hide what they overlap.
A rule must be settled by the byte after its match (all of the rules here are): one that could match at a place,
and go on to fail at a longer match, is refused, as is one that matches nothing at all.

The bytes of many texts are read side by side by numpy, those of the last long ones by themselves. The automaton itself tells where a text may be cut: at bytes after
which every state is the first one (line ends, most punctuation), so a very long text is read in many lanes too, and a
text without such bytes in one, with the same matches.

Nulls and empty texts have no secrets: numbers of zero, spans '' and the digest of ''. Offsets count code points. Of spans
that start together, kinds go in the order of the rules. Repeated rows are scanned as rows of their own. Very long texts
are scanned whole. An empty table gives an empty result. Extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A byte that UTF-8 never has: it stands between texts, and no class holds it.
STOP = 255
#: Most states of an automaton; bytes of a lane; bytes of texts read together.
MOST_STATES, LANE, TOGETHER = 60_000, 2048, 1 << 23
#: Lanes from which it is quicker to move all of them by numpy than each by itself.
MANY = 128


@dataclass(frozen=True)
class Rule:
    """head, then tail; a match counts if it has `least` bytes and its tail `least_tail`."""

    kind: str
    tail: str
    head: str = ""
    least: int = 0
    least_tail: int = 0


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


#: Fixed patterns of the base rules.
ASSIGN_KEY = f"(?:{either_case('password|passwd|secret|token|api_?key')})"
ASSIGN_HEAD, ASSIGN_TAIL = ASSIGN_KEY + r"[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+"
BASE = (
    Rule("assign", ASSIGN_TAIL, ASSIGN_HEAD, least_tail=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),  # shorter runs, which all words have, needn't be told
)
#: Added: signed web tokens, tokens of code hosts and chat services by their prefixes, heads of private keys.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("prefixed", r"(?:gh[opsru]_|xox[abprs]-|sk_live_)[A-Za-z0-9-]+", least=24),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class Nfa:
    """Thompson's automaton of a pattern: literals, classes, groups, alternatives and repeats.

    `moves` lists (from, set of bytes, to), `free` (from, to); `first` and `last` are its ends.
    """

    def __init__(self, pattern: str):
        self.moves: list[tuple[int, frozenset[int], int]] = []
        self.free: list[tuple[int, int]] = []
        self.n, self.text, self.at = 0, pattern, 0
        self.first, self.last = self._either()
        if self.at < len(pattern):
            raise ValueError(f"unbalanced bracket at {self.at} of {pattern!r}")

    def _new(self) -> int:
        self.n += 1
        return self.n - 1

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self, wanted: str = "") -> str:
        c = self._peek()
        if not c or wanted and c != wanted:
            raise ValueError(f"{wanted or 'more'} expected at {self.at} of {self.text!r}")
        self.at += 1
        return c

    def _either(self) -> tuple[int, int]:
        parts = [self._row()]
        while self._peek() == "|":
            self._take()
            parts.append(self._row())
        a, b = self._new(), self._new()
        self.free += [(a, p) for p, _ in parts] + [(q, b) for _, q in parts]
        return a, b

    def _row(self) -> tuple[int, int]:
        a = b = self._new()
        while self._peek() not in ("", "|", ")"):
            p, q = self._repeat()
            self.free.append((b, p))
            b = q
        return a, b

    def _repeat(self) -> tuple[int, int]:
        began = self.at
        p, q = self._one()
        least, most, c = 1, 1, self._peek()
        if c and c in "*+?":
            self._take()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        elif c == "{":
            low, _, high = self.text[self.at + 1 : self.text.index("}", self.at)].partition(",")
            least, most = int(low), int(high) if high else None if "," in self.text[self.at : self.text.index("}", self.at)] else int(low)
            self.at = self.text.index("}", self.at) + 1
        else:
            return p, q
        ended, a = self.at, self._new()
        b, copies = a, [(p, q)]
        while len(copies) < max(least, most or 1, 1):  # further copies are read from the pattern again
            self.at = began
            copies.append(self._one())
        self.at = ended
        after = self._new()
        for i, (s, t) in enumerate(copies):
            if i >= least:
                self.free.append((b, after))
            self.free.append((b, s))
            b = t
        if most is None:
            self.free.append((b, copies[-1][0]))
        self.free.append((b, after))
        return a, after

    def _one(self) -> tuple[int, int]:
        c = self._take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            found = self._either()
            self._take(")")
            return found
        if c in "*+?{":
            raise ValueError(f"nothing to repeat at {self.at} of {self.text!r}")
        held = self._class() if c == "[" else frozenset(range(STOP)) - {10} if c == "." else frozenset([self._byte(c)])
        a, b = self._new(), self._new()
        self.moves.append((a, held, b))
        return a, b

    def _byte(self, c: str) -> int:
        if c == "\\":
            c = self._take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            c = {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)
            if c.isalnum():
                raise ValueError(f"\\{c} isn't read")
        if ord(c) > 127:
            raise ValueError("patterns are ASCII; write other bytes as \\xHH")
        return ord(c)

    def _class(self) -> frozenset[int]:
        out, other = set(), self._peek() == "^"
        if other:
            self._take()
        while (c := self._take()) != "]":
            low = high = self._byte(c)
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("", "]"):
                self._take()
                high = self._byte(self._take())
            out |= set(range(low, high + 1))
        return frozenset(range(STOP)) - out if other else frozenset(out - {STOP})

    def reversed(self) -> Nfa:
        out = Nfa.__new__(Nfa)
        out.n, out.first, out.last = self.n, self.last, self.first
        out.moves, out.free = [(b, s, a) for a, s, b in self.moves], [(b, a) for a, b in self.free]
        return out


class Steps:
    """Sets of an automaton's states, and what a byte makes of them."""

    def __init__(self, nfa: Nfa):
        self.nfa, self.by, self.ways = nfa, {}, {}
        for a, b in nfa.free:
            self.ways.setdefault(a, []).append(b)
        for a, held, b in nfa.moves:
            self.by.setdefault(a, []).append((held, b))
        self.start = self.closed([nfa.first])

    def closed(self, states: Sequence[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for b in self.ways.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(s for s in seen if s in self.by or s == self.nfa.last)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed([b for a in states for held, b in self.by.get(a, ()) if byte in held])

    def ends(self, states: frozenset[int]) -> bool:
        return self.nfa.last in states


class Search:
    """Leftmost matches of one rule anywhere: a state is the groups of states of starts that are still open, oldest first, and whether the oldest has matched."""

    def __init__(self, nfa: Nfa, kind: str):
        self.steps, self.kind = Steps(nfa), kind
        if self.steps.ends(self.steps.start):
            raise ValueError(f"rule {kind} matches nothing at all")
        self.first, self.known = ((), False), {}

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended before this byte."""
        if (state, byte) not in self.known:
            self.known[state, byte] = self._step(state, byte)
        return self.known[state, byte]

    def _step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        groups, matched = state
        out, seen = [], set()
        for g in (*groups, *(() if matched else (self.steps.start,))):
            g = frozenset(self.steps.step(g, byte) - seen)
            seen |= g
            if g:
                out.append(g)
        if matched and not out:  # the match is over, and the search goes on from this byte
            return self._step(self.first, byte)[0], True
        ends = [self.steps.ends(g) for g in out]
        if any(ends) and not ends[0] or matched and not ends[0]:
            raise ValueError(f"rule {self.kind} isn't settled by the byte after its match")
        return ((tuple(out[:1]), True) if any(ends) else (tuple(out), False)), False


def classes_of(sets: Sequence[frozenset[int]]) -> np.ndarray:
    """A class for each byte: bytes that no set tells apart share one. The stop byte has a class of its own."""
    kinds: dict[tuple, int] = {}
    return np.array([kinds.setdefault((b == STOP, *(b in s for s in sets)), len(kinds)) for b in range(256)])


def minimised(moves: np.ndarray, told: np.ndarray) -> np.ndarray:
    """The class of each state: states of a class tell the same and go to the same classes, whatever is read."""
    kind, n = np.unique(told, return_inverse=True)[1], 0
    while len(found := np.unique(rows := np.column_stack([kind, kind[moves]]), axis=0)) != n:
        n = len(found)
        kind = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    return kind


class Automaton:
    """The combined, minimised automaton: next[state * n_classes + class], and by state which rules' matches have ended.

    States that end a match are the last ones, from `telling` on; 0 is the first state.
    """

    def __init__(self, rules: Sequence[Rule]):
        nfas = [Nfa(r.head + r.tail) for r in rules]
        searches = [Search(n, r.kind) for n, r in zip(nfas, rules, strict=True)]
        of_byte = classes_of(sorted({s for n in nfas for _, s, _ in n.moves}, key=sorted))
        bytes_ = [int(np.flatnonzero(of_byte == c)[0]) for c in range(of_byte.max() + 1)]
        first = (tuple(s.first for s in searches), 0)
        numbers, order, moves = {first: 0}, [first], []
        for states, _ in order:  # grows as it is read
            row = []
            for b in bytes_:
                found = [s.step(x, b) for s, x in zip(searches, states, strict=True)]
                to = (tuple(x for x, _ in found), sum(1 << i for i, (_, over) in enumerate(found) if over))
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
                    if len(order) > MOST_STATES:
                        raise ValueError("the rules make too many states together")
                row.append(numbers[to])
            moves.append(row)
        moves, told = np.array(moves), np.array([t for _, t in order])
        kind = minimised(moves, told)
        one = np.unique(kind, return_index=True)[1]  # a state of each class
        rank = np.empty(len(one), np.int64)
        rank[sorted(range(len(one)), key=lambda k: (told[one[k]] != 0, k != kind[0]))] = np.arange(len(one))
        table, told_by = np.empty((len(one), len(bytes_)), np.int32), np.empty(len(one), np.int64)
        table[rank], told_by[rank] = rank[kind[moves[one]]], told[one]
        self.of_byte, self.n_classes, self.n_states, self.built = of_byte.astype(np.uint8), len(bytes_), len(one), len(order)
        self.next, self.told = table, told_by
        self.telling = int((told_by == 0).sum())
        # classes after which every state goes on as the first one does
        self.resets = np.array([(table[table[:, c]] == table[0]).all() for c in range(len(bytes_))])[of_byte]

    def ends(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, state) wherever a match ended before the byte at that place. data: texts, each followed by STOP; starts: of texts, in order."""
        cuts = np.flatnonzero(self.resets[data]) + 1
        wanted = np.arange(0, len(data), LANE)
        lanes = np.unique(np.concatenate([starts, cuts[np.minimum(np.searchsorted(cuts, wanted), len(cuts) - 1)]]))
        lanes = lanes[lanes < len(data)]
        ends = np.append(lanes[1:], len(data))
        order = np.argsort(lanes - ends, kind="stable")  # longest first
        at, lengths = lanes[order], (ends - lanes)[order]
        left = len(at) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")  # lanes longer than so many bytes
        read, move = self.of_byte[data], (self.next.astype(np.int64) * self.n_classes).ravel()
        state, telling, found = np.zeros(len(at), np.int64), self.telling * self.n_classes, []
        side_by_side = int(np.searchsorted(-left, -MANY, "right"))  # steps with so many lanes
        for i, n in enumerate(left[:side_by_side].tolist()):
            state = move[state[:n] + read[at[:n] + i]]
            if state.max() >= telling:
                hit = np.flatnonzero(state >= telling)
                found.append((at[hit] + i, state[hit] // self.n_classes))
        alone = int(left[side_by_side]) if side_by_side < len(left) else 0
        moves = move.tolist() if alone else []
        for s, start, length in zip(state[:alone].tolist(), at[:alone].tolist(), lengths[:alone].tolist(), strict=True):
            hits = []
            for place, c in enumerate(read[start + side_by_side : start + length].tobytes(), start + side_by_side):
                s = moves[s + c]
                if s >= telling:
                    hits.append((place, s // self.n_classes))
            if hits:
                found.append(tuple(np.array(hits).T))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, state = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place)
        return place[order], state[order]


class Anchored:
    """A deterministic automaton of one pattern from a fixed place, made as far as it is used."""

    def __init__(self, nfa: Nfa):
        self.steps = Steps(nfa)
        self.known: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def longest(self, data: bytes, at: int, stop: int, by: int) -> int:
        """The place furthest from `at` (in steps of by, before `stop`) up to which data matches; `at` if none does."""
        state, best, known = self.steps.start, at, self.known
        while at != stop:
            byte = data[at if by > 0 else at - 1]
            if (state, byte) not in known:
                known[state, byte] = self.steps.step(state, byte)
            state = known[state, byte]
            if not state:
                break
            at += by
            if self.steps.ends(state):
                best = at
        return best


class Scanner:
    """Spans of all rules in texts."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules, self.automaton = list(rules), Automaton(rules)
        self.back = [Anchored(Nfa(r.head + r.tail).reversed()) for r in rules]
        self.head = [Anchored(Nfa(r.head)) for r in rules]

    def scan(self, texts: Sequence[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule) of each text's matches in bytes, in order."""
        if not texts:
            return []
        data = b"".join([t + b"\xff" for t in texts])
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = ends - np.array([len(t) + 1 for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        place, state = self.automaton.ends(np.frombuffer(data, np.uint8), starts)
        over: dict[int, int] = {}  # of each rule, the end of its last match
        for end, told, of in zip(place.tolist(), self.automaton.told[state].tolist(), np.searchsorted(ends, place, "right").tolist(), strict=True):
            first = int(starts[of])
            for k, r in enumerate(self.rules):
                if told >> k & 1:
                    start = self.back[k].longest(data, end, max(first, over.get(k, 0)), -1)
                    over[k] = end
                    if end - start >= r.least and end - self.head[k].longest(data, start, end, 1) >= r.least_tail:
                        out[of].append((start - first, end - first, k))
        return [sorted(spans, key=lambda s: (s[0], s[2])) for spans in out]


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def scanned(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end>> in code points by start, then in the order of the rules.

    The automaton is compiled once, here, and sent along: its size is set by the rules.
    """
    scanner, kinds = Scanner(rules), [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, texts = 0, batch.column(0), batch.column(1).to_pylist()
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size < TOGETHER):
                    size += len(texts[to] or b"")
                    to += 1
                part = [t or b"" for t in texts[at:to]]
                found = [[(kinds[k], a, b) for a, b, k in in_code_points(t, s)] for t, s in zip(part, scanner.scan(part), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(found, pa.list_(span))], ["doc_id", "spans"])
                at = to

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return out.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(written(of(*base)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _spans_sql(k: int, r: Rule) -> str:
    """The matches of a rule: pieces between matches and the matches themselves, whose lengths add up to places."""
    pattern = f"{r.head}({r.tail})".replace("'", "''")
    found = f"""SELECT rid, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i, unnest(string_split_regex(t, '{pattern}')) AS piece,
      unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', 1)) AS tail FROM d"""
    placed = f"SELECT rid, m, tail, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ({found}) WINDOW w AS (PARTITION BY rid ORDER BY i)"
    return f"SELECT rid, {k} AS k, '{r.kind}' AS kind, s, s + length(m) AS e FROM ({placed}) WHERE m IS NOT NULL AND length(m) >= {r.least} AND length(tail) >= {r.least_tail}"


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(RULES))}),
y AS (SELECT *, kind || ':' || s::BIGINT || ':' || e::BIGINT AS span FROM x)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN y USING (rid) GROUP BY rid, doc_id
"""

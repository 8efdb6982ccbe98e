"""Regular expressions over bytes, compiled to one deterministic automaton.

Supported: literals, escapes (\\xHH, \\d, \\w, \\s and escaped punctuation), classes with ranges and negation, `.`,
groups, alternation, ?, *, +, {m}, {m,}, {m,n}. Each expression becomes an NFA fragment, the fragments are joined, the
subset construction makes them deterministic and partition refinement makes the result minimal. Matching is
leftmost-longest.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np

CLASSES = {"d": frozenset(b"0123456789"), "s": frozenset(b" \t\n\r\x0b\x0c"), "w": frozenset(b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}
ANY = frozenset(range(256)) - {10}


class Parser:
    """Syntax trees: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unbalanced ) at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                inner = self.p[self.i : self.p.index("}", self.i)]
                self.i += len(inner) + 1
                low, comma, high = inner.partition(",")
                least = int(low)
                most = (int(high) if high else None) if comma else least
            part = ("rep", part, least, most)
        return part

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", ANY)
        if c == "\\":
            return ("set", self.cased(self.escape()))
        data = c.encode()
        return ("set", self.cased({data[0]})) if len(data) == 1 else ("cat", [("set", frozenset({b})) for b in data])

    def escape(self) -> frozenset[int]:
        c = self.take()
        if c == "x":
            self.i += 2
            return frozenset({int(self.p[self.i - 2 : self.i], 16)})
        if c in CLASSES:
            return CLASSES[c]
        return frozenset({{"n": 10, "t": 9, "r": 13}.get(c, ord(c))})

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while (c := self.take()) != "]":
            first = self.escape() if c == "\\" else frozenset({ord(c)})
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]" and len(first) == 1:
                self.i += 1
                d = self.take()
                last = self.escape() if d == "\\" else frozenset({ord(d)})
                first = frozenset(range(min(first), min(last) + 1))
            found |= first
        found = set(self.cased(found))
        return frozenset(range(256)) - found if negated else frozenset(found)

    def cased(self, members) -> frozenset[int]:
        if not self.any_case:
            return frozenset(members)
        letters = {b ^ 32 for b in members if 65 <= (b & ~32) <= 90}
        return frozenset(members) | letters


class Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def build(self, tree, start: int) -> int:
        """Add the tree after start; its last state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.build(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.build(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.build(part, start)
        self.free[start].append(end)
        return end


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:])


def shortened(tree):
    """The tree without what only makes a match longer: each of its matches begins with one of the result's.

    The combined automaton needs no more, and without the runs at the ends of rules its subsets stay few.
    """
    kind = tree[0]
    if kind == "alt":
        return ("alt", [shortened(x) for x in tree[1]])
    if kind == "cat":
        parts = list(tree[1])
        while parts and parts[-1][0] == "rep" and parts[-1][2] == 0:
            parts.pop()
        return ("cat", [*parts[:-1], shortened(parts[-1])] if parts else [])
    if kind == "rep":
        return ("rep", tree[1], tree[2], tree[2])
    return tree


@dataclass
class Dfa:
    """Row-major transitions, 256 a state; a state's number is its row's place in them. Accepting states come last."""

    moves: array
    start: int
    accepting: int  # rows from here on accept
    rules: dict[int, tuple[int, ...]]  # row -> rules that end there
    dead: int  # the row that nothing leaves, or -1

    @property
    def states(self) -> int:
        return len(self.moves) // 256


def compile_rules(trees: list, anywhere: bool) -> Dfa:
    """One automaton for all trees; anywhere: a match may begin at every byte."""
    nfa = Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for n, tree in enumerate(trees):
        first = nfa.state()
        nfa.free[root].append(first)
        ends[nfa.build(tree, first)] = n
    if anywhere:
        nfa.steps[root].append((frozenset(range(256)), root))

    # Bytes that no expression tells apart share one column.
    sets = list(dict.fromkeys(s for steps in nfa.steps for s, _ in steps))
    kinds: dict[tuple, list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    columns = list(kinds.values())

    closures: list[frozenset[int]] = []
    for s in range(len(nfa.free)):
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        closures.append(frozenset(seen))

    first = closures[root]
    number, order, table = {first: 0}, [first], []
    for subset in order:
        row = []
        for column in columns:
            b = column[0]
            after = frozenset().union(*(closures[t] for s in subset for members, t in nfa.steps[s] if b in members))
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        table.append(row)
    marks = [tuple(sorted(ends[s] for s in subset if s in ends)) for subset in order]
    return _minimal(np.array(table), marks, columns)


def _minimal(table: np.ndarray, marks: list[tuple], columns: list[list[int]]) -> Dfa:
    """Merge states that no input tells apart: refine the partition by marks until it is stable."""
    names = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    block = np.array([names[m] for m in marks])
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    one = np.zeros(n, np.int64)
    one[block] = np.arange(len(block))
    # Accepting states last, so that one comparison finds them.
    order = sorted(range(n), key=lambda k: bool(marks[one[k]]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    moves = np.zeros((n, 256), np.int64)
    for j, column in enumerate(columns):
        moves[np.ix_(np.arange(n), column)] = place[block[table[one[order], j]]][:, None]
    rules = {int(place[k]) * 256: marks[one[k]] for k in range(n) if marks[one[k]]}
    accepting = min(rules, default=n * 256)
    dead = next((k * 256 for k in range(n) if k * 256 < accepting and (moves[k] == k).all()), -1)
    return Dfa(array("i", (moves * 256).ravel().tolist()), int(place[block[0]]) * 256, accepting, rules, dead)


class Scanner:
    """Leftmost-longest, non-overlapping matches of every rule, from one pass over the bytes for all of them."""

    def __init__(self, rules: list[tuple[str, str, bool]]):
        """rules: name, expression, whether letters match in either case. No rule may match the empty string."""
        trees = [Parser(p, any_case).parse() for _, p, any_case in rules]
        self.names = [name for name, _, _ in rules]
        self.all = compile_rules([shortened(t) for t in trees], anywhere=True)
        if self.all.start >= self.all.accepting:
            raise ValueError("a rule matches the empty string")
        self.forward = [compile_rules([t], anywhere=False) for t in trees]
        self.backward = [compile_rules([reverse(t)], anywhere=False) for t in trees]
        rows = {r: r for r in range(0, len(self.all.moves), 256)}  # one object a row, not one a transition
        self.moves = [rows[m] for m in self.all.moves]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of every match, by rule and start."""
        moves, state, accepting = self.moves, self.all.start, self.all.accepting
        hits = []
        for at, b in enumerate(data):
            state = moves[state + b]
            if state >= accepting:
                hits.append((at, state))
        if not hits:
            return []
        found = []
        done = [0] * len(self.names)
        for at, state in hits:
            for rule in self.all.rules[state]:
                if at >= done[rule]:
                    start = self._start(rule, data, at, done[rule])
                    if start is not None:
                        end = self._end(rule, data, start)
                        found.append((rule, start, end))
                        done[rule] = end
        return sorted(found)

    def _start(self, rule: int, data: bytes, last: int, least: int) -> int | None:
        """The leftmost start, not before least, of a match whose last byte is at last."""
        dfa = self.backward[rule]
        moves, state, best = dfa.moves, dfa.start, None
        for at in range(last, least - 1, -1):
            state = moves[state + data[at]]
            if state == dfa.dead:
                break
            if state >= dfa.accepting:
                best = at
        return best

    def _end(self, rule: int, data: bytes, start: int) -> int:
        dfa = self.forward[rule]
        moves, state, best = dfa.moves, dfa.start, start
        for at in range(start, len(data)):
            state = moves[state + data[at]]
            if state == dfa.dead:
                break
            if state >= dfa.accepting:
                best = at + 1
        return best

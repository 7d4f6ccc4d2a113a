"""Deterministic automata over bytes: rules are compiled by subset construction and minimised.

The rule syntax is the plain part of regular expressions: literals, ``.``-free classes, ``|``, groups,
``(?i:...)`` and the quantifiers ``? * + {m} {m,} {m,n}``. Sets of bytes are integers of 256 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ESCAPES = {"d": (48, 58), "t": (9, 10), "n": (10, 11), "r": (13, 14)}


def _span(low: int, high: int) -> int:
    return (1 << high) - (1 << low)


def _both_cases(mask: int) -> int:
    upper, lower = _span(65, 91), _span(97, 123)
    return mask | (mask & upper) << 32 | (mask & lower) >> 32


class _Rule:
    """One rule as a tree: ("set", mask), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False

    def tree(self):
        out = self._alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unbalanced rule: {self.text}")
        return out

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _alternatives(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._next()
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            part = self._atom()
            while self._peek() in ("?", "*", "+", "{"):
                part = ("rep", part, *self._bounds())
            parts.append(part)
        return ("cat", parts)

    def _bounds(self) -> tuple[int, int | None]:
        mark = self._next()
        if mark != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at:end].partition(",")
        self.at = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def _atom(self):
        c = self._next()
        if c == "(":
            fold = self.fold
            for head in ("?i:", "?:"):
                if self.text.startswith(head, self.at):
                    self.at += len(head)
                    self.fold = fold or head == "?i:"
                    break
            out = self._alternatives()
            self._next()
            self.fold = fold
            return out
        mask = self._class() if c == "[" else self._escape() if c == "\\" else 1 << ord(c)
        return ("set", _both_cases(mask) if self.fold else mask)

    def _escape(self) -> int:
        c = self._next()
        if c == "x":
            self.at += 2
            return 1 << int(self.text[self.at - 2:self.at], 16)
        return _span(*_ESCAPES[c]) if c in _ESCAPES else 1 << ord(c)

    def _class(self) -> int:
        mask = 0
        while self._peek() != "]":
            c = self._next()
            one = self._escape() if c == "\\" else 1 << ord(c)
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._next()
                one = _span(one.bit_length() - 1, ord(self._next()) + 1)
            mask |= one
        self._next()
        return mask


def _reversed(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    parts = [_reversed(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """Add ``tree`` behind ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start] += [loop]
            self.free[self.add(part, loop)] += [loop]
            self.free[loop] += [end]
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """``moves[state + classes[byte]]`` is the next state; states are multiplied by the number of classes.

    States from ``accepting`` on accept; ``rules[state]`` are the rules they accept. State ``dead``, if
    there is one, never accepts again.
    """

    moves: list[int]
    classes: bytes
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int

    @property
    def states(self) -> int:
        return len(self.moves) // (max(self.classes) + 1)

    def longest(self, data: bytes, start: int, end: int, step: int = 1) -> int:
        """Where the longest match that begins at ``start`` ends, or -1; backwards if ``step`` is -1."""
        s, out, moves, classes = self.start, -1, self.moves, self.classes
        for i in range(start, end, step):
            s = moves[s + classes[data[i]]]
            if s == self.dead:
                break
            if s >= self.accepting:
                out = i + step
        return out


def compile_rules(rules: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """The minimal deterministic automaton of all rules; ``anywhere`` lets a match begin at any byte."""
    nfa = _Nfa()
    begin, ends = nfa.state(), {}
    for number, text in enumerate(rules):
        tree = _Rule(text).tree()
        first = nfa.state()
        nfa.free[begin].append(first)
        ends[nfa.add(_reversed(tree) if backwards else tree, first)] = number

    masks = {mask for moves in nfa.moves for mask, _ in moves}
    kinds: dict[tuple[bool, ...], int] = {}
    classes = bytes(kinds.setdefault(tuple(bool(m >> b & 1) for m in sorted(masks)), len(kinds)) for b in range(256))
    one = [1 << classes.index(k) for k in range(len(kinds))]

    root = nfa.closed([begin])
    number, todo, table, accepts = {root: 0}, [root], [], []
    for states in todo:
        accepts.append(tuple(sorted(ends[s] for s in states if s in ends)))
        row = []
        for bit in one:
            target = nfa.closed([t for s in states for mask, t in nfa.moves[s] if mask & bit])
            if anywhere:
                target |= root
            if target not in number:
                number[target] = len(todo)
                todo.append(target)
            row.append(number[target])
        table.append(row)

    moves = np.array(table)
    names = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    label = np.array([names[a] for a in accepts])
    while True:  # states stay together while they accept the same rules and lead to the same blocks
        _, refined = np.unique(np.column_stack([label, label[moves]]), axis=0, return_inverse=True)
        if refined.max() == label.max() and len(np.unique(label)) == refined.max() + 1:
            break
        label = refined.reshape(-1)
    blocks = {}
    for s, block in enumerate(label):
        blocks.setdefault(block, s)
    order = sorted(blocks, key=lambda b: (bool(accepts[blocks[b]]), b))
    place = np.empty(len(order), dtype=int)
    place[order] = np.arange(len(order))
    width = len(kinds)
    flat = [int(place[label[t]]) * width for b in order for t in moves[blocks[b]]]
    accepting = sum(not accepts[blocks[b]] for b in order) * width
    dead = next((i * width for i, b in enumerate(order)
                 if i * width < accepting and all(label[t] == b for t in moves[blocks[b]])), -1)
    return Automaton(flat, classes, int(place[label[0]]) * width, accepting,
                     {i * width: accepts[blocks[b]] for i, b in enumerate(order) if accepts[blocks[b]]}, dead)

"""Rules as one deterministic automaton over bytes: subset construction and minimisation.

A rule is written with classes, groups, alternatives and the repeats ``? * + {m,n} {m,}``.
Each rule must end in an open repeat of a class or be closed by its own last byte, so that
the end of a match is the last byte of an unbroken run of accepting states.
"""

from __future__ import annotations

from collections.abc import Sequence

_ESCAPES = {"d": frozenset(b"0123456789"), "n": frozenset(b"\n"), "t": frozenset(b"\t")}
_META = "|)?*+{"


def parse(rule: str, any_case: bool = False):
    """A rule as nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", node, low, high)."""
    at = 0

    def fold(codes) -> frozenset[int]:
        codes = set(codes)
        if any_case:
            codes |= {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(codes)

    def escaped() -> frozenset[int]:
        nonlocal at
        c = rule[at]
        at += 1
        if c == "x":
            at += 2
            return frozenset([int(rule[at - 2 : at], 16)])
        return _ESCAPES.get(c) or frozenset(c.encode())

    def one_class() -> frozenset[int]:
        nonlocal at
        negated = rule[at] == "^"
        at += negated
        codes: set[int] = set()
        while rule[at] != "]":
            if rule[at] == "\\":
                at += 1
                low = escaped()
            else:
                low = frozenset(rule[at].encode())
                at += 1
            if rule[at] == "-" and rule[at + 1] != "]":
                codes |= set(range(min(low), ord(rule[at + 1]) + 1))
                at += 2
            else:
                codes |= low
        at += 1
        return frozenset(range(256)) - fold(codes) if negated else fold(codes)

    def choice():
        nonlocal at
        parts = [sequence()]
        while at < len(rule) and rule[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        nonlocal at
        parts = []
        while at < len(rule) and rule[at] not in "|)":
            c = rule[at]
            at += 1
            if c == "(":
                if rule.startswith("?:", at):
                    at += 2
                node = choice()
                at += 1
            elif c == "[":
                node = ("set", one_class())
            elif c == "\\":
                node = ("set", fold(escaped()))
            else:
                raw = c.encode()
                node = ("cat", [("set", fold([b])) for b in raw]) if len(raw) > 1 else ("set", fold(raw))
            while at < len(rule) and rule[at] in "?*+{":
                c = rule[at]
                at += 1
                if c == "{":
                    end = rule.index("}", at)
                    low, comma, high = rule[at:end].partition(",")
                    at = end + 1
                    node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
                else:
                    node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            parts.append(node)
        return ("cat", parts)

    return choice()


def reverse(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), *node[2:])


class Automaton:
    """``table[state | byte]`` is the next state; states are multiples of 256.

    States from ``accepting`` on end a match, of the rules whose bits ``marks[state >> 8]``
    holds. ``start`` is the first state, ``dead`` the one without a way on (or -1).
    """

    def __init__(self, nodes: Sequence, anywhere: bool):
        self._moves: list[list[tuple[frozenset[int], int]]] = []
        self._free: list[list[int]] = []
        begin, ends = self._new(), {}
        for i, node in enumerate(nodes):
            first = self._new()
            self._free[begin].append(first)
            ends[self._add(node, first)] = 1 << i
        self._build(begin, ends, anywhere)

    def _new(self) -> int:
        self._moves.append([])
        self._free.append([])
        return len(self._moves) - 1

    def _add(self, node, at: int) -> int:
        kind = node[0]
        if kind == "set":
            to = self._new()
            self._moves[at].append((node[1], to))
            return to
        if kind == "cat":
            for x in node[1]:
                at = self._add(x, at)
            return at
        if kind == "alt":
            to = self._new()
            for x in node[1]:
                first = self._new()
                self._free[at].append(first)
                self._free[self._add(x, first)].append(to)
            return to
        _, inner, low, high = node
        for _ in range(low):
            at = self._add(inner, at)
        if high is None:
            loop, to = self._new(), self._new()
            self._free[at].append(loop)
            self._free[self._add(inner, loop)].append(loop)
            self._free[loop].append(to)
            return to
        to = self._new()
        self._free[at].append(to)
        for _ in range(high - low):
            at = self._add(inner, at)
            self._free[at].append(to)
        return to

    def _closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self._free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _build(self, begin: int, ends: dict[int, int], anywhere: bool) -> None:
        # bytes that no class tells apart move alike
        kinds: dict[tuple, int] = {}
        sets = sorted({s for moves in self._moves for s, _ in moves}, key=sorted)
        of_byte = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        example = {k: b for b, k in reversed(list(enumerate(of_byte)))}
        first = self._closed([begin])
        number, todo, rows = {first: 0}, [first], []
        while todo:
            states = todo.pop(0)
            row = []
            for k in range(len(kinds)):
                b = example[k]
                to = {t for s in states for codes, t in self._moves[s] if b in codes}
                target = self._closed(to | {begin}) if anywhere else self._closed(to)
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                row.append(number[target])
            rows.append(row)
        mark = [0] * len(number)
        for states, i in number.items():
            for s in states:
                mark[i] |= ends.get(s, 0)
        # minimisation: split blocks until all states of a block move to the same blocks
        block, n = mark, len(set(mark))
        while True:
            names: dict[tuple, int] = {}
            block = [names.setdefault((block[i], *(block[t] for t in row)), len(names)) for i, row in enumerate(rows)]
            if len(names) == n:
                break
            n = len(names)
        kept = {}
        for i, b in enumerate(block):
            kept.setdefault(b, i)
        order = sorted(kept, key=lambda b: (mark[kept[b]] != 0, b))
        place = {b: i for i, b in enumerate(order)}
        self.marks = [mark[kept[b]] for b in order]
        names = [i << 8 for i in range(len(order))]  # one object a state, however often the table names it
        self.table = []
        for b in order:
            to = [names[place[block[t]]] for t in rows[kept[b]]]
            self.table += [to[k] for k in of_byte]
        self.start = place[block[0]] << 8
        self.accepting = sum(m == 0 for m in self.marks) << 8
        stuck = [i for i, m in enumerate(self.marks) if not m and set(self.table[i << 8 : (i + 1) << 8]) == {i << 8}]
        self.dead = stuck[0] << 8 if stuck else -1

"""Regular expressions over bytes compiled into one deterministic automaton: Thompson's construction, subset
construction over classes of bytes, and minimisation by partition refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_STATES = 200_000
END = 255  #: the byte after a text's last one; UTF-8 doesn't use it, so that no class of a rule may hold it
_SETS = {"d": range(48, 58), "w": [*range(48, 58), *range(65, 91), 95, *range(97, 123)], "s": [9, 10, 11, 12, 13, 32]}
_CHARS = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """Literals, escapes, classes, groups, alternation, repetition and, for the end of a text, ``$``. A byte set is a
    frozenset; a tree is ('set', s), ('cat', [..]), ('alt', [..]), ('rep', tree, least, most), where most is None
    for any number, or ('end',)."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.p, self.i = pattern[4:] if self.fold else pattern, 0

    def parse(self):
        tree = self.alt()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.p!r} ends too early")
        self.i += 1
        return c

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("cat", parts)

    def repeat(self, tree):
        while (c := self.peek()) in ("?", "*", "+", "{"):
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                high = int(high) if high else None if comma else int(low)
                low, self.i = int(low), end + 1
            tree = ("rep", tree, low, high)
        return tree

    def leaf(self, values):
        s = set(values)
        if self.fold:
            s |= {b ^ 32 for b in s if 65 <= b & ~32 <= 90}
        return frozenset(s)

    def escape(self):
        c = self.take()
        if c in _SETS:
            return set(_SETS[c])
        if c.lower() in _SETS:
            return set(range(256)) - set(_SETS[c.lower()])
        return {_CHARS.get(c, ord(c))}

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.alt()
            if self.take() != ")":
                raise ValueError(f"a group isn't closed in {self.p!r}")
            return tree
        if c == "[":
            return ("set", self.leaf(self.klass()))
        if c == "\\":
            return ("set", self.leaf(self.escape()))
        if c == ".":
            return ("set", frozenset(set(range(256)) - {10}))
        if c == "$":
            return ("end",)
        if c == "^":
            raise ValueError("there is no anchor at the beginning; use a rule's left context")
        raw = c.encode()
        return ("cat", [("set", self.leaf([b])) for b in raw]) if len(raw) > 1 else ("set", self.leaf(raw))

    def klass(self) -> set[int]:
        deny = self.peek() == "^"
        self.i += deny
        found: set[int] = set()
        while (c := self.take()) != "]":
            one = self.escape() if c == "\\" else {ord(c)}
            if len(one) == 1 and self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.i += 1
                to = self.take()
                one = set(range(min(one), (min(self.escape()) if to == "\\" else ord(to)) + 1))
            found |= one
        return set(range(256)) - found if deny else found


def parse(pattern: str):
    return _text_only(_Parser(pattern).parse())


def _text_only(tree):
    """The tree without END in its byte sets."""
    kind = tree[0]
    if kind == "end":
        return tree
    if kind == "set":
        return ("set", tree[1] - {END})
    if kind in ("cat", "alt"):
        return (kind, [_text_only(t) for t in tree[1]])
    return ("rep", _text_only(tree[1]), *tree[2:])


def longest(tree) -> int:
    """Bytes of the longest match; an error if there is none."""
    kind = tree[0]
    if kind == "set":
        return 1
    if kind == "end":
        return 0
    if kind == "cat":
        return sum(map(longest, tree[1]))
    if kind == "alt":
        return max(map(longest, tree[1]))
    if tree[3] is None:
        raise ValueError("a rule's head must be of bounded length; what goes on for any length is its tail")
    return tree[3] * longest(tree[1])


def reverse(tree):
    kind = tree[0]
    if kind in ("set", "end"):
        return tree
    if kind == "cat":
        return ("cat", [reverse(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(t) for t in tree[1]])
    return ("rep", reverse(tree[1]), tree[2], tree[3])


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + byte_class[b]]`` is the next state times ``classes``. States from
    ``accepting`` on (times ``classes``) accept the rules in ``rules[state - accepting // classes]``."""

    byte_class: np.ndarray
    table: np.ndarray
    classes: int
    start: int
    accepting: int
    rules: list[tuple[int, ...]]
    dead: int

    def match(self, buf: np.ndarray, at: int) -> int:
        """Where the longest match that begins at ``at`` ends; -1 if there is none. ``buf`` must hold END after
        the text; a match's END isn't counted. Reads ``buf`` piece by piece, as far as a match may go on."""
        if not hasattr(self, "_steps"):
            object.__setattr__(self, "_steps", (self.table.tolist(), self.byte_class.tobytes()))
        table, classes = self._steps
        state, found, size = self.start, at if self.start >= self.accepting else -1, 64
        while at < len(buf):
            raw = buf[at : at + size].tobytes()
            stop = raw.find(END)
            for i, c in enumerate((raw if stop < 0 else raw[: stop + 1]).translate(classes)):
                state = table[state + c]
                if state == self.dead:
                    return found
                if state >= self.accepting:
                    found = at + i + (i != stop)
            if stop >= 0:
                return found
            at += len(raw)
            size = min(size * 2, 1 << 16)
        return found


def build(trees: list, search: bool) -> Automaton:
    """One automaton for all trees. With ``search`` a match may begin anywhere, so that the state after a byte
    tells which rules match up to it; without, the input must match from its start, and ``dead`` is the state
    from which nothing can (-1 if there is none)."""
    step: list[list[tuple[frozenset, int]]] = []
    free: list[list[int]] = []
    ends: dict[int, int] = {}

    def state() -> int:
        step.append([])
        free.append([])
        return len(step) - 1

    def add(tree, at: int) -> int:
        kind = tree[0]
        if kind in ("set", "end"):
            to = state()
            step[at].append((tree[1] if kind == "set" else frozenset({END}), to))
            return to
        if kind == "cat":
            for t in tree[1]:
                at = add(t, at)
            return at
        if kind == "alt":
            to = state()
            for t in tree[1]:
                begin = state()
                free[at].append(begin)
                free[add(t, begin)].append(to)
            return to
        for _ in range(tree[2]):
            at = add(tree[1], at)
        out = state()
        free[at].append(out)
        if tree[3] is None:
            begin = state()
            free[out].append(begin)
            free[add(tree[1], begin)].append(out)
            return out
        for _ in range(tree[3] - tree[2]):
            at = add(tree[1], at)
            free[at].append(out)
        return out

    root = state()
    for k, tree in enumerate(trees):
        begin = state()
        free[root].append(begin)
        ends[add(tree, begin)] = k

    sets = sorted({s for edges in step for s, _ in edges}, key=sorted)
    member = np.zeros((256, max(1, len(sets))), dtype=bool)
    for j, s in enumerate(sets):
        member[list(s), j] = True
    _, first, byte_class = np.unique(member, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.ravel()
    classes = len(first)
    moves = [[(to, [c for c in range(classes) if first[c] in s]) for s, to in edges] for edges in step]

    closed: dict[int, frozenset] = {}

    def closure(n: int) -> frozenset:
        if n not in closed:
            seen, todo = {n}, [n]
            while todo:
                for m in free[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            closed[n] = frozenset(m for m in seen if moves[m] or m in ends)
        return closed[n]

    base = closure(root)
    number: dict[frozenset, int] = {base: 0}
    order, rows = [base], []
    for now in order:
        found: list[set[int]] = [set() for _ in range(classes)]
        for n in now:
            for to, cs in moves[n]:
                near = closure(to)
                for c in cs:
                    found[c] |= near
        row = []
        for s in found:
            f = frozenset(s | base) if search else frozenset(s)
            if f not in number:
                number[f] = len(order)
                order.append(f)
                if len(order) > MOST_STATES:
                    raise ValueError("the rules need too many states together; give them a left context or fewer repeats")
            row.append(number[f])
        rows.append(row)

    table = np.array(rows, dtype=np.int64)
    accepts = [tuple(sorted({ends[n] for n in s if n in ends})) for s in order]
    names = {a: k for k, a in enumerate(sorted(set(accepts)))}
    part = np.array([names[a] for a in accepts])
    while True:  # states stay together as long as no byte class tells them apart
        _, new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == part.max():
            break
        part = new
    count = part.max() + 1
    pick = np.zeros(count, dtype=np.int64)
    pick[part[::-1]] = np.arange(len(part))[::-1]
    small, acc = part[table[pick]], [accepts[i] for i in pick]
    place = np.array(sorted(range(count), key=lambda s: (bool(acc[s]), s)))
    rank = np.empty(count, dtype=np.int64)
    rank[place] = np.arange(count)
    small = rank[small[place]]
    plain = sum(not a for a in acc)
    dead = [s for s in range(plain) if (small[s] == s).all()] if not search else []
    return Automaton(byte_class.astype(np.uint8), (small * classes).astype(np.int32).ravel(), classes, int(rank[part[0]]) * classes, plain * classes, [acc[s] for s in place[plain:]], dead[0] * classes if dead else -1)

"""One automaton for many span rules.

Each rule is a small regular expression over bytes. It is compiled to a position automaton, made
deterministic by subset construction with threads kept in order of preference (earlier start first,
so matches are leftmost and do not overlap), and the rules' automata are combined to one whose state
holds a state of each. Moore's refinement merges equal states. Transitions are one flat array over
byte classes, and one pass over a text's bytes finds the ends of all rules' matches. A start is
found by reading back from an end with the rule's reversed automaton, which needs the length of the
match only.

A rule's match must end in a loop or at a fixed byte: from an accepting state every byte either
keeps it accepting or ends the match.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Not a byte of UTF-8: ends the matches that are open at a text's end.
END = 0xFF
ACCEPT = -1


class _Parser:
    """Literals, classes, (?i:...), groups, alternation, ? * + and {m,} {m} over ASCII, as a tree of tuples."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def parse(self) -> tuple:
        tree = self.alternatives(False)
        if self.at != len(self.text):
            raise ValueError(f"cannot read rule at {self.at}: {self.text}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternatives(self, fold: bool) -> tuple:
        options = [self.sequence(fold)]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence(fold))
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self, fold: bool) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            part = self.atom(fold)
            while self.peek() and self.peek() in "?*+{":
                part = self.repeat(part)
            parts.append(part)
        return ("seq", parts)

    def repeat(self, part: tuple) -> tuple:
        c = self.peek()
        self.at += 1
        if c == "?":
            return ("opt", part)
        if c == "*":
            return ("opt", ("plus", part))
        if c == "+":
            return ("plus", part)
        end = self.text.index("}", self.at)
        least, comma, most = self.text[self.at : end].partition(",")
        self.at = end + 1
        if most:
            raise ValueError("only {m} and {m,} are read")
        body = [part] * int(least)
        return ("seq", [*body[:-1], ("plus", part)] if comma else body)

    def atom(self, fold: bool) -> tuple:
        c = self.peek()
        self.at += 1
        if c == "(":
            inner_fold = fold
            if self.text.startswith("?i:", self.at):
                self.at, inner_fold = self.at + 3, True
            tree = self.alternatives(inner_fold)
            if self.peek() != ")":
                raise ValueError("a group is not closed")
            self.at += 1
            return tree
        if c == "[":
            end = self.text.index("]", self.at)
            body, chars, i = self.text[self.at : end], set(), 0
            self.at = end + 1
            while i < len(body):
                if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
                    chars |= {chr(k) for k in range(ord(body[i]), ord(body[i + 2]) + 1)}
                    i += 3
                else:
                    chars.add(body[i])
                    i += 1
        elif c == "\\":
            chars = {self.peek()}
            self.at += 1
        else:
            chars = {c}
        if fold:
            chars |= {x.lower() for x in chars} | {x.upper() for x in chars}
        return ("set", frozenset(ord(x) for x in chars))


def _reversed(tree: tuple) -> tuple:
    kind, body = tree
    if kind == "seq":
        return (kind, [_reversed(x) for x in body[::-1]])
    if kind == "or":
        return (kind, [_reversed(x) for x in body])
    return tree if kind == "set" else (kind, _reversed(body))


class _Positions:
    """Glushkov automaton: one position for each set in the rule; lists are in order of preference (greedy)."""

    def __init__(self, tree: tuple):
        self.sets: list[frozenset[int]] = []
        self.follow: list[list[int]] = []
        empty, self.first, last = self._walk(tree)
        if empty:
            raise ValueError("a rule must not match the empty text")
        self.last = set(last)

    def _walk(self, tree: tuple) -> tuple[bool, list[int], list[int]]:
        kind, body = tree
        if kind == "set":
            self.sets.append(body)
            self.follow.append([])
            p = len(self.sets) - 1
            return False, [p], [p]
        if kind == "or":
            parts = [self._walk(x) for x in body]
            return any(e for e, _, _ in parts), [p for _, f, _ in parts for p in f], [p for _, _, z in parts for p in z]
        if kind == "opt":
            _, first, last = self._walk(body)
            return True, first, last
        if kind == "plus":
            empty, first, last = self._walk(body)
            for p in last:
                self.follow[p] += [q for q in first if q not in self.follow[p]]
            return empty, first, last
        empty, first, last = True, [], []
        for x in body:
            e, f, z = self._walk(x)
            for p in last:
                self.follow[p] += [q for q in f if q not in self.follow[p]]
            first = first + f if empty else first
            last = last + z if e else z
            empty = empty and e
        return empty, first, last

    def step(self, threads: Sequence[int], byte: int) -> list[int]:
        """Positions reached by reading a byte at one of the expected positions, in order, with ACCEPT where the rule may end."""
        out: list[int] = []
        for p in threads:
            if byte in self.sets[p]:
                out += [q for q in self.follow[p] if q not in out]
                if p in self.last:
                    return [*out, ACCEPT]  # what is less preferred cannot win any more
        return out


def _rule_table(rule: _Positions, reps: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and ends[state, class] of one rule, searching from every position of a text."""
    start = tuple(rule.first)
    number, todo = {start: 0}, [start]
    nxt: list[list[int]] = []
    ends: list[list[bool]] = []
    for state in todo:
        row, over = [], []
        for byte in reps:
            ended = False
            if ACCEPT in state:
                new = rule.step([p for p in state if p != ACCEPT], byte)
                if new and ACCEPT not in new:
                    raise ValueError("a match must end in a loop or at a fixed byte")
                ended = not new
            if ACCEPT not in state or ended:
                new = rule.step(start if ended else state, byte)
                if ACCEPT not in new:
                    new += [p for p in start if p not in new]
            key = tuple(new)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
            over.append(ended)
        nxt.append(row)
        ends.append(over)
    return np.array(nxt, np.int64), np.array(ends, bool)


def _minimised(nxt: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states with equal outputs and equal successors, until none are left."""
    block = np.unique(out, axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[nxt]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    # number blocks by their first state, so that the start stays 0
    _, first, renamed = np.unique(block, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    block = rank[renamed]
    keep = np.sort(first)
    return block[nxt[keep]], out[keep]


class Scanner:
    """All rules in one automaton. rules: (kind, expression), in the order in which spans at one place are listed."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.kinds = [k for k, _ in rules]
        trees = [_Parser(x).parse() for _, x in rules]
        forward = [_Positions(t) for t in trees]
        self.backward = [_Positions(_reversed(t)) for t in trees]
        self._back_steps: list[dict] = [{} for _ in rules]
        sets = {s for r in forward for s in r.sets}
        signature: dict[tuple, list[int]] = {}
        for b in range(256):
            signature.setdefault(tuple(b in s for s in sorted(sets, key=sorted)), []).append(b)
        groups = list(signature.values())
        self.classes = bytes(next(i for i, g in enumerate(groups) if b in g) for b in range(256))
        reps = [g[0] for g in groups]
        tables = [_rule_table(r, reps) for r in forward]
        radix = np.cumprod([1, *(len(t) for t, _ in tables)])
        if radix[-1] >= 2**62:
            raise ValueError("too many states to combine")
        known, frontier = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(frontier):  # reachable states only, a layer at a time
            nxt = sum(t[(frontier // r) % len(t)] * r for (t, _), r in zip(tables, radix[:-1], strict=True))
            frontier = np.setdiff1d(nxt, known)
            known = np.union1d(known, frontier)
        nxt = sum(t[(known // r) % len(t)] * r for (t, _), r in zip(tables, radix[:-1], strict=True))
        ended = sum(e[(known // r) % len(e)].astype(np.int64) << i for i, ((_, e), r) in enumerate(zip(tables, radix[:-1], strict=True)))
        self.unminimised = len(known)
        nxt, ended = _minimised(np.searchsorted(known, nxt), ended)
        # a state that is entered when matches end gets a copy for each set of rules that ends, numbered after the plain states
        pairs = np.unique(np.column_stack([ended[ended > 0], nxt[ended > 0]]), axis=0)
        n, width = len(nxt), len(groups)
        copy = {(int(m), int(s)): n + i for i, (m, s) in enumerate(pairs)}
        goto = nxt.copy()
        for (m, s), c in copy.items():
            goto[(ended == m) & (nxt == s)] = c
        goto = np.concatenate([goto, goto[pairs[:, 1]]]) if len(pairs) else goto
        self.states, self.plain = len(goto), n * width
        self.ended = {(n + i) * width: int(m) for i, (m, _) in enumerate(pairs)}
        numbers = [s * width for s in range(len(goto))]
        self.table = [numbers[s] for s in goto.ravel().tolist()]

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then the order of the rules; the end is exclusive."""
        data = text.encode("utf-8") + bytes([END])
        table, plain, s, found = self.table, self.plain, 0, []
        for at, c in enumerate(data.translate(self.classes)):
            s = table[s + c]
            if s >= plain:
                found.append((at, self.ended[s]))
        if not found:
            return []
        out, since = [], [0] * len(self.kinds)
        for end, mask in found:
            for k in range(len(self.kinds)):
                if mask >> k & 1:
                    out.append((self._start(k, data, since[k], end), k, end))
                    since[k] = end
        out.sort()
        if len(data) == len(text) + 1:
            return [(self.kinds[k], a, b) for a, k, b in out]
        cuts = sorted({x for a, _, b in out for x in (a, b)})
        points, seen = {}, 0
        for a, b in zip([0, *cuts], cuts, strict=False):
            seen += len(data[a:b].decode("utf-8"))
            points[b] = seen
        points.setdefault(0, 0)
        return [(self.kinds[k], points[a], points[b]) for a, k, b in out]

    def _start(self, k: int, data: bytes, least: int, end: int) -> int:
        """The earliest start, not before ``least``, of a match of rule k that ends at ``end``."""
        rule, steps = self.backward[k], self._back_steps[k]
        threads, start, at = tuple(rule.first), end, end
        while at > least and threads:
            at -= 1
            key = (threads, data[at])
            if key not in steps:
                reached: list[int] = []
                for p in threads:
                    if data[at] in rule.sets[p]:
                        reached += [q for q in rule.follow[p] if q not in reached]
                accepted = any(data[at] in rule.sets[p] and p in rule.last for p in threads)
                steps[key] = (tuple(sorted(reached)), accepted)
            threads, accepted = steps[key]
            if accepted:
                start = at
        return start

"""Byte-pair encoding and decoding with an automaton compiled from the merge list.

Compilation takes the merges in order and adds one gadget each. The start is the automaton whose
single state loops on every byte. Merge (a, b) -> c

* takes arc ``b`` away from the state that ``a`` leads to,
* gives every state that could read ``a`` and then ``b`` the new arc ``c``,
* lets ``c`` lead to a copy of the state that ``b`` led to at that time.

The state after a token depends on that token only, so states are numbered like tokens. Written out
arc by arc, the result for 50,000 merges would hold more than 10^9 arcs, so the gadgets stay factored:
``inherits[c] = b``, ``opened_by[c] = a`` and a table of the arcs taken away. Arc (t, u) is looked
up by undoing gadgets from the latest to the earliest; a path is accepted iff all its arcs exist, and
each word has exactly one accepted path, which is its encoding.

To encode, a second table (goto transitions over the token spellings, with suffix links) gives the
tokens ending at each byte, and the one with an arc from the state reached before it is the only
one on the path. All words of a batch move one byte at a time together in numpy; words of more than ``LONG`` bytes go by themselves,
with a table of the arcs that were looked up, so that a byte of them costs a few lookups.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import regex

#: The pre-split pattern of the byte-level vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers; the memory is emptied beyond it.
CACHE_WORDS = 300_000
#: Bytes of a word from which it is encoded by itself, and arcs that are remembered for such words.
LONG, CACHE_ARCS = 96, 1_000_000


def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ArcTable:
    """Open-addressed table of (token, token) -> merge, read by arrays of keys."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(8, int(len(left)).bit_length() + 4)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros(size, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        todo, slots = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self.keys[slots[todo]] < 0
            place = todo[free]
            first = place[np.unique(slots[place], return_index=True)[1]]
            self.keys[slots[first]] = keys[first]
            self.values[slots[first]] = value[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            taken = todo[self.keys[slots[todo]] != keys[todo]]
            slots[taken] = (slots[taken] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray, absent: int) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], absent)
        at = np.flatnonzero((held != keys) & (held >= 0))
        while len(at):
            slots[at] = (slots[at] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[at]]
            hit = held == keys[at]
            out[at[hit]] = self.values[slots[at[hit]]]
            at = at[~hit & (held >= 0)]
        return out


class MergeAutomaton:
    """The compiled automaton. Tokens are numbered 0-255 for bytes, then by merge; ``ids`` maps them to the vocabulary."""

    def __init__(self, merges: Sequence[tuple[int, int]], ids: Sequence[int]):
        n = 256 + len(merges)
        self.ids = np.asarray(ids, np.int64)
        self.opened_by, self.inherits = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        spelled = [bytes([b]) for b in range(256)]
        for c, (a, b) in enumerate(merges, 256):  # one gadget for each merge
            self.opened_by[c], self.inherits[c] = a, b
            spelled.append(spelled[a] + spelled[b])
        if len(set(spelled)) != n:
            raise ValueError("two merges spell the same token")
        self.spelled = spelled
        self.length = np.array([len(s) for s in spelled], np.int32)
        self.taken = ArcTable(self.opened_by[256:], self.inherits[256:], np.arange(256, n))
        # a merge whose arc b was gone from the state after a when its turn came never opens its token
        opened = self.has_arc(self.opened_by[256:], self.inherits[256:], np.arange(256, n, dtype=np.int32))
        self.live = np.ones(n, bool)
        for c, (a, b) in enumerate(merges, 256):
            self.live[c] = opened[c - 256] and self.live[a] and self.live[b]
        self._spelling_table()
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.flat_at = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.steps = self.length.tolist(), self.shorter.tolist(), self.longest.tolist(), memoryview(self.goto.reshape(-1))
        self.arcs: dict[int, bool] = {}

    def _spelling_table(self) -> None:
        """goto[node, byte] over all spellings, the longest token ending at a node, and each token's next shorter suffix token."""
        children: list[dict[int, int]] = [{}]
        token_at, parent, by_depth = [-1], [0], [[0]]
        for t, word in enumerate(self.spelled):
            if not self.live[t]:
                continue
            node = 0
            for depth, byte in enumerate(word, 1):
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                    token_at.append(-1)
                    parent.append(node)
                    if len(by_depth) <= depth:
                        by_depth.append([])
                    by_depth[depth].append(nxt)
                node = nxt
            token_at[node] = t
        self.goto = np.zeros((len(children), 256), np.int32)
        fail = np.zeros(len(children), np.int32)
        self.longest = np.array(token_at, np.int32)
        self.shorter = np.full(len(self.spelled), -1, np.int32)
        for level in by_depth:
            nodes = np.array(level)
            if nodes[0]:
                self.goto[nodes] = self.goto[fail[nodes]]
                own = self.longest[nodes]
                below = self.longest[fail[nodes]]
                self.shorter[own[own >= 0]] = below[own >= 0]
                self.longest[nodes] = np.where(own >= 0, own, below)
            for node in level:
                for byte, child in children[node].items():
                    fail[child] = self.goto[node, byte] if node else 0
                    self.goto[node, byte] = child

    def has_arc(self, state: np.ndarray, token: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the state after ``state`` can read ``token``: gadgets are undone from the latest back. before: as it was before these merges."""
        out = np.ones(len(state), bool)
        at, x, y = np.arange(len(state)), state.copy(), token.copy()
        bound = np.full(len(state), len(self.ids), np.int32) if before is None else before
        while len(at):
            gone = self.taken.get(x, y, len(self.ids)) < bound
            out[at[gone]] = False
            more = ~gone & ((x >= 256) | (y >= 256))
            at, x, y = at[more], x[more], y[more]
            later = x > y
            bound = np.where(later, x, y + 1)  # an equal merge further left comes first
            x, y = np.where(later, self.inherits[x], x), np.where(later, y, self.opened_by[y])
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """Tokens of one word."""
        length, shorter, longest, goto = self.steps
        arcs, last, node = self.arcs, array("i", [0]) * len(word), 0
        for j, byte in enumerate(word):
            node = goto[node << 8 | byte]
            token = longest[node]
            while (before := j - length[token]) >= 0:
                key = last[before] << 32 | token
                there = arcs.get(key)
                if there is None:
                    if len(arcs) >= CACHE_ARCS:
                        arcs.clear()
                    there = arcs[key] = bool(self.has_arc(np.array([last[before]], np.int32), np.array([token], np.int32))[0])
                if there:
                    break
                token = shorter[token]
            last[j] = token
        out, j = [], len(word) - 1
        while j >= 0:
            out.append(last[j])
            j -= length[last[j]]
        return np.array(out[::-1], np.int32)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and how many each has. Words are not empty."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._encode_together(words)
        apart = set(long)
        rest = [i for i in range(len(words)) if i not in apart]
        tokens, counts = self._encode_together([words[i] for i in rest])
        cuts = np.cumsum(counts)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for i, end, n in zip(rest, cuts.tolist(), counts.tolist(), strict=True):
            parts[i] = tokens[end - n : end]
        for i in long:
            parts[i] = self.encode_long(words[i])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _encode_together(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.full(len(data), -1, np.int32)  # the token that ends at each byte on the accepted path
        node = np.zeros(len(words), np.int32)
        active = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(words) else 0) + 1), side="right")
        for j, n in enumerate(active):
            at = starts[:n] + j
            node = self.goto[node[:n], data[at]]
            token = self.longest[node].copy()
            open_ = np.arange(n)
            while len(open_):
                t = token[open_]
                before = j - self.length[t]  # the byte on which the token before it ends
                inner = before >= 0
                ok = ~inner
                which = np.flatnonzero(inner)
                if len(which):
                    ok[which] = self.has_arc(last[starts[open_[which]] + before[which]], t[which])
                open_ = open_[~ok]
                token[open_] = self.shorter[token[open_]]
            last[at] = token
        counts = np.zeros(len(words), np.int64)
        ends = starts + lengths[order] - 1
        back, live = ends.copy(), np.arange(len(words))
        steps = []
        while len(live):
            t = last[back[live]]
            steps.append((live, t))
            counts[live] += 1
            back[live] -= self.length[t]
            live = live[back[live] >= starts[live]]
        out_counts = np.zeros(len(words), np.int64)
        out_counts[order] = counts
        first = (np.cumsum(out_counts) - out_counts)[order]
        out = np.zeros(int(out_counts.sum()), np.int32)
        for k, (live, t) in enumerate(steps):
            out[first[live] + counts[live] - 1 - k] = t
        return out, out_counts

    def spell(self, tokens: np.ndarray) -> np.ndarray:
        """Bytes on the arcs of a path."""
        n = self.length[tokens].astype(np.int64)
        shift = np.repeat(self.flat_at[tokens] - (np.cumsum(n) - n), n)
        return self.flat[np.arange(len(shift)) + shift]


class BytePairCodec:
    """Encodes and decodes whole texts; ``specials`` are strings that are tokens by themselves."""

    def __init__(self, automaton: MergeAutomaton, specials: dict[str, int]):
        self.automaton, self.specials = automaton, specials
        self.pattern = regex.compile(WORD_PATTERN)
        names = sorted(specials, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        n = int(max([*automaton.ids, *specials.values()])) + 1
        self.token_of = np.full(n, -1, np.int32)
        self.token_of[automaton.ids] = np.arange(len(automaton.ids))
        self._forget()

    @classmethod
    def from_file(cls, path: str) -> BytePairCodec:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        number = {letter: byte for letter, byte in letters.items()}
        merges = []
        for c, (a, b) in enumerate(pairs, 256):
            merges.append((number[a], number[b]))
            number[a + b] = c
        ids = [0] * (256 + len(merges))
        for name, t in number.items():
            ids[t] = model["vocab"][name]
        return cls(MergeAutomaton(merges, ids), {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.word_at: np.ndarray = np.zeros(0, np.int64)
        self.word_n: np.ndarray = np.zeros(0, np.int64)
        self.kept = np.zeros(0, np.int32)

    def _learn(self, words: Iterable[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        plain = [w for w in new if w not in self.specials]
        tokens, counts = self.automaton.encode_words([w.encode("utf-8") for w in plain])
        ids = self.automaton.ids[tokens]
        special = [w for w in new if w in self.specials]
        ids = np.concatenate([ids, np.array([self.specials[w] for w in special], np.int64)])
        counts = np.concatenate([counts, np.ones(len(special), np.int64)])
        base = len(self.kept)
        self.kept = np.concatenate([self.kept, ids.astype(np.int32)])
        self.word_at = np.concatenate([self.word_at, base + np.cumsum(counts) - counts])
        self.word_n = np.concatenate([self.word_n, counts])
        self.known.update(zip(plain + special, range(len(self.known), len(self.known) + len(new)), strict=True))

    def split(self, text: str) -> list[str]:
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            out += [part] if part in self.specials else self.pattern.findall(part)
        return out

    def encode_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text."""
        words: list[str] = []
        ends = []
        for text in texts:
            words += self.split(text)
            ends.append(len(words))
        self._learn(set(words))
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = self.word_n[index]
        total = np.concatenate([[0], np.cumsum(n)])
        shift = np.repeat(self.word_at[index] - total[:-1], n)
        ids = self.kept[np.arange(len(shift)) + shift]
        cuts = total[np.array([0, *ends], np.int64)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: arc labels in a row, and special strings; bytes that are not UTF-8 become U+FFFD."""
        tokens = self.token_of[ids]
        if (tokens >= 0).all():
            return self.automaton.spell(tokens).tobytes().decode("utf-8", "replace")
        names, out = {v: k.encode() for k, v in self.specials.items()}, []
        cuts = np.flatnonzero(tokens < 0)
        for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
            out.append(self.automaton.spell(tokens[a:b]).tobytes())
            if b < len(ids):
                out.append(names[int(ids[b])])
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One compiled codec for each worker and vocabulary file."""
    return BytePairCodec.from_file(path)

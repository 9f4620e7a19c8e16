"""Language identification by unigram pieces, summed over all segmentations of a text.

The pieces are a fixed public vocabulary. Every language gets a probability for each piece; the
probability of a word is the sum over all its segmentations into pieces, by the forward algorithm in logarithms, and
a text's is the product over its words (letters with the marks that follow them, lower case, with a word mark before them). A letter
that is in no piece is spelt by the vocabulary's byte pieces, so every word has a probability. Training is
expectation-maximisation: from a start that depends on the place in the vocabulary only, the expected number of uses of each
piece over all segmentations (forward-backward) gives new probabilities for each language, until the likelihood settles. Each
language's probabilities are smoothed by those that all languages share.

Fitting takes at most ``TRAIN_DOCS`` documents of each language (a bounded sample, chosen by a hash of
the id). Words of any length are scored whole.

Null texts and texts without a letter are ``und`` with score 0; else the score is the language's posterior probability, all
languages being equally likely before. Rows with a null id are scored, and
never learnt from; repeated rows are scored alike. Ties go to the language that sorts first. An empty
table gives an empty result; where nothing can be learnt, every text is ``und``.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import chunks, crc_remainder, filter_rows, gathered, map_arrow, ship
from ripplemark.llm.labelled import bounded_sample

TRAIN_DOCS = 5_000
MARK = "▁"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: Byte pieces stand after all code points.
BYTES = 0x110000
#: Share of every language's probability that is spread evenly over the pieces.
EVEN = 1e-4
#: Uses that the shared probabilities count for.
SHARED = 20.0
#: Training ends when the log-likelihood of a word gains less than this, or after so many rounds.
SETTLED, ROUNDS = 1e-3, 30
#: Symbols (words x longest word) that are summed at once, and words that a task remembers, if they have at most so many symbols.
AT_ONCE, CACHE, SHORT = 60_000, 300_000, 64
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary with a hash table from substrings of words to pieces.

    A word is a sequence of symbols: the code points of its letters, or BYTES and more for the bytes of letters that are in no piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names: dict[tuple[int, ...], int] = {}
        for i in range(model.vocab_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                names.setdefault((BYTES + int(name[3:5], 16),), len(names))
            elif not model.is_control(i) and not model.is_unknown(i):
                name = name.lower()
                if name == MARK or LETTERS.fullmatch(name.removeprefix(MARK)):
                    names.setdefault(tuple(map(ord, name)), len(names))
        self.letters = {x for n in names for x in n if x < BYTES}
        for x in sorted(self.letters):
            names.setdefault((x,), len(names))
        for x in range(256):
            names.setdefault((BYTES + x,), len(names))
        self.names, self.size, self.longest = list(names), len(names), max(map(len, names))
        self.is_letter = np.zeros(BYTES, bool)
        self.is_letter[list(self.letters)] = True
        # no piece goes on from a substring whose place is not marked
        self.goes_on = np.zeros(1 << 20, bool)
        for k in range(1, self.longest + 1):
            starts = np.array(sorted({n[:k] for n in names if len(n) > k}), np.uint64)
            if len(starts):
                self.goes_on[self._hash(starts) >> np.uint64(44)] = True
        keys = np.array([self._hash(np.array([n], np.uint64))[0] for n in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], order.astype(np.int32)
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.slot_from = np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=np.uint64)[:-1] << self.shift).astype(np.int32)
        self.slot_from = np.append(self.slot_from, len(self.keys)).astype(np.int32)
        self.most_in_slot = int(np.diff(self.slot_from).max())
        start = 1.0 / (np.arange(self.size) + 50.0)
        self.start = (1 - EVEN) * start / start.sum() + EVEN / self.size

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = Pieces._add(h, codes[:, j])
        return h

    @staticmethod
    def _add(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ (code + np.uint64(0x2545F491))) * _BASE
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each substring hash, -1 if none."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.slot_from[slot], self.slot_from[slot + 1]
        out = np.full(len(h), -1, np.int32)
        for _ in range(self.most_in_slot):
            live = np.flatnonzero(at < end)
            if not len(live):
                break
            hit = self.keys[at[live]] == h[live]
            out[live[hit]] = self.values[at[live[hit]]]
            at[live] += 1
            at[live[hit]] = end[live[hit]]
        return out

    def symbols(self, word: str) -> list[int]:
        """A marked word as symbols."""
        out = []
        for c in MARK + word:
            if ord(c) in self.letters:
                out.append(ord(c))
            else:
                out += [BYTES + x for x in c.encode("utf-8", "surrogatepass")]
        return out

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, "Lattice"]]:
        """Lattices of words of about the same length, of AT_ONCE symbols or one word, with the places of their words."""
        if not words:
            return
        codes = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(~self.is_letter[codes]), side="right") - 1)
        if len(odd):  # words with letters that are in no piece
            spelt = [np.array(self.symbols(words[i]), np.uint64) for i in odd]
            starts[odd] = len(codes) + np.cumsum([0, *map(len, spelt[:-1])])
            lengths[odd] = list(map(len, spelt))
            codes = np.concatenate([codes, *spelt])
        order = np.argsort(lengths, kind="stable")
        begin = 0
        while begin < len(order):
            end = begin + 1
            step = 4096
            while step:  # as many as fit: the length of the last one counts for all
                more = min(end + step, len(order))
                if more > end and (more - begin) * int(lengths[order[more - 1]]) <= AT_ONCE:
                    end = more
                else:
                    step //= 2
            some = order[begin:end]
            yield some, Lattice(self, codes, starts[some], lengths[some])
            begin = end


class Lattice:
    """All ways to cut words into pieces: an edge for each piece that stands somewhere in a word."""

    def __init__(self, pieces: Pieces, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Words are stretches of codes (symbols)."""
        self.n, self.lengths, self.width = len(lengths), lengths, int(lengths.max())
        r, c = np.nonzero(np.arange(self.width)[None, :] < lengths[:, None])
        at = starts[r] + c
        left = lengths[r] - c  # symbols from here to the end of the word
        h = np.zeros(len(at), np.uint64)
        row, begin, end, piece = [], [], [], []
        for size in range(1, pieces.longest + 1):
            h = pieces._add(h, codes[at + size - 1])
            found = pieces.find(h)
            hit = found >= 0
            row.append(r[hit])
            begin.append(c[hit])
            end.append(c[hit] + size)
            piece.append(found[hit])
            on = (left > size) & pieces.goes_on[h >> np.uint64(44)]
            r, c, at, left, h = r[on], c[on], at[on], left[on], h[on]
            if not len(r):
                break
        self.row, self.begin, self.end, self.piece = (np.concatenate(x) for x in (row, begin, end, piece))

    def _sweep(self, logs: np.ndarray, by: np.ndarray, other: np.ndarray, first: np.ndarray, positions) -> np.ndarray:
        """Sums over the edges at each position, taken in turn; first: where a word starts the sum."""
        order = np.lexsort((self.row, by))
        row, of, piece = self.row[order], other[order], self.piece[order]
        bounds = np.searchsorted(by[order], np.arange(self.width + 2))
        # the edges of one row and position are neighbours
        out = np.full((self.width + 1, self.n, logs.shape[1]), -np.inf)
        out[first, np.arange(self.n)] = 0.0
        for j in positions:
            a, b = bounds[j], bounds[j + 1]
            if a == b:
                continue
            rows = row[a:b]
            x = out[of[a:b], rows] + logs[piece[a:b]]
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            if len(starts) == len(rows):
                out[j, rows] = x
                continue
            top = np.maximum.reduceat(x, starts)
            part = np.cumsum(np.diff(rows, prepend=rows[0]) != 0)
            out[j, rows[starts]] = top + np.log(np.add.reduceat(np.exp(x - top[part]), starts))
        return out

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """alpha[j, word, language]: log of the sum over segmentations of the first j symbols. logs: pieces x languages."""
        return self._sweep(logs, self.end, self.begin, np.zeros(self.n, np.int64), range(1, self.width + 1))

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """beta[j, word, language]: log of the sum over segmentations of what follows the first j symbols."""
        return self._sweep(logs, self.begin, self.end, self.lengths, range(self.width - 1, -1, -1))

    def totals(self, logs: np.ndarray) -> np.ndarray:
        """Log-probabilities, words x languages."""
        return self.forward(logs)[self.lengths, np.arange(self.n)]

    def uses(self, logs: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        """languages x pieces: expected uses over all segmentations; and the weighted log-likelihood. weights: words x languages."""
        alpha, beta = self.forward(logs), self.backward(logs)
        total = alpha[self.lengths, np.arange(self.n)]
        use = np.exp(alpha[self.begin, self.row] + logs[self.piece] + beta[self.end, self.row] - total[self.row]) * weights[self.row]
        return np.stack([np.bincount(self.piece, u, size) for u in use.T]), float((total * weights).sum())


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Scorer:
    """Log-likelihoods of words for all languages; short ones are remembered in a task."""

    def __init__(self, pieces: Pieces, langs: list[str], p: np.ndarray):
        self.pieces, self.langs = pieces, langs
        self.logs = np.ascontiguousarray(np.log(p).T)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros((1024, len(self.langs)))

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self._forget()
        new = [w for w in words if w not in self.known]
        base = len(self.known)
        while len(self.values) < base + len(new):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        for places, lattice in self.pieces.batches(new):
            self.values[base + places] = lattice.totals(self.logs)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and posterior probability of each text."""
        words: list[str] = []
        ends = []
        for t in texts:
            words += words_of(t)
            ends.append(len(words))
        if self.langs:
            self.learn(set(words))
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) if self.langs else np.zeros(0, np.int64)
        bounds = np.array([0, *ends], np.int64)
        some = np.flatnonzero(np.diff(bounds)) if self.langs else np.zeros(0, np.int64)
        out = [(UNKNOWN, 0.0)] * len(ends)
        if len(some):  # texts with words: their words follow one another
            total = np.add.reduceat(self.values[index], bounds[:-1][some], axis=0)
            e = np.exp(total - total.max(axis=1, keepdims=True))
            best = e.argmax(axis=1)
            score = e[np.arange(len(some)), best] / e.sum(axis=1)
            for i, k, x in zip(some.tolist(), best.tolist(), score.tolist(), strict=True):
                out[i] = self.langs[k], x
        if words and max(map(len, words)) > SHORT:
            self._forget()
        return out


def smoothed(uses: np.ndarray, start: np.ndarray) -> np.ndarray:
    """languages x pieces: probabilities from expected uses."""
    shared = (uses.sum(axis=0) + start) / (uses.sum() + 1.0)
    p = (uses + SHARED * shared) / (uses.sum(axis=1, keepdims=True) + SHARED)
    return (1 - EVEN) * p + EVEN / len(start)


def fit(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from a bounded sample of the labelled rows given."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null")
    sample, sizes = bounded_sample(rows, "lang", most)
    langs = sorted(sizes)
    pieces = pieces_of(vocabulary)
    if not langs:
        return [], np.zeros((0, pieces.size))
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        seen: Counter = Counter()

        def out():
            if seen:
                lang, word = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(word, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])
                seen.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.update(zip(itertools.repeat(place[lang]), words_of(text)))  # noqa: B905
            if len(seen) > 200_000:
                yield from out()
        yield from out()

    counted = map_arrow(sample.select("lang", "text"), count, "lang int, word string, n long").groupBy("word")
    counted = counted.agg(*(F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(langs)))).persist(StorageLevel.DISK_ONLY)
    p = np.tile(pieces.start, (len(langs), 1))
    before = None
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(np.log(p).T)  # vocabulary x languages numbers

        def expect(batches, shared=shared):
            own = pieces_of(vocabulary)
            uses, gain, words = np.zeros((len(langs), own.size)), 0.0, 0.0
            for b in batches:
                weights = np.stack([b.column(f"n{i}").to_numpy(zero_copy_only=False) for i in range(len(langs))], 1).astype(float)
                spelt = np.array(b.column("word").to_pylist(), object)
                for lang in range(len(langs)):  # most words are of one language
                    mine = np.flatnonzero(weights[:, lang])
                    for places, lattice in own.batches(spelt[mine].tolist()):
                        more, likelihood = lattice.uses(shared.value[:, [lang]], weights[mine[places]][:, [lang]], own.size)
                        uses[lang] += more[0]
                        gain += likelihood
                words += weights.sum()
            at = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array([*at[0], -1, -2], pa.int32()), pa.array([*at[1], 0, 0], pa.int32()), pa.array([*uses[at], gain, words], pa.float64())], ["lang", "piece", "uses"])

        parts = map_arrow(counted, expect, "lang int, piece int, uses double")
        found = gathered(parts.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")))  # at most languages x vocabulary
        of = dict(zip(found["lang"], found["uses"], strict=True))
        uses = np.zeros((len(langs), pieces.size))
        real = found[found["lang"] >= 0]
        uses[real["lang"].to_numpy(), real["piece"].to_numpy()] = real["uses"]
        p = smoothed(uses, pieces.start)
        likelihood = of.get(-1, 0.0) / max(1.0, of.get(-2, 0.0))
        shared.destroy()
        if before is not None and likelihood - before < SETTLED:
            break
        before = likelihood
    counted.unpersist()
    return langs, p


def predict(df: DataFrame, vocabulary: str, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary numbers

    def run(batches):
        scorer = Scorer(pieces_of(vocabulary), *shared.value)
        for part, texts in chunks(batches, "text"):
            found = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(rows, run, "doc_id long, lang_pred string, score double")


def identify(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from rows whose crc32 of the id is not 1 modulo 3, and scores all."""
    remainder = crc_remainder("doc_id", 3)
    model = fit(df.where(remainder != 1), vocabulary)
    return predict(df, vocabulary, model).withColumn("held_out", F.coalesce(remainder == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(df: DataFrame, vocabulary: str, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows whose text is in a language; all columns stay."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def decide():
        scorer = Scorer(pieces_of(vocabulary), *shared.value)
        return lambda texts: [lang != UNKNOWN for lang, _ in scorer.score(texts)]

    return filter_rows(df, decide, text_col)

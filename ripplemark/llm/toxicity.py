"""Toxicity by two class-conditional Kneser-Ney models over words.

Both classes have a bigram model that backs off to the class's own word model, and that to counts the classes share.
All counts are continuation counts, of the distinct words that stand before an expression, so copies of a
text add nothing. With N the sum of a class's counts (for pairs: those of the pair's first word), a class gives

    P(w)   = (c(w) - d(w)) / N + L * S(w)               L    = sum of d / N
    P(w|v) = (c(vw) - d(vw)) / N(v) + L(v) * P(w)       L(v) = sum of d / N(v); P(w|v) = P(w) after a word that the class does not know

As in modified Kneser-Ney the discount depends on the count: d takes what the other class has too (at the same rate), and
``step`` times the square root of the count more, at most all of it. So a rare expression, or one that both classes use alike,
takes the shared estimate in both and is no evidence. S is proportional to what the discounts took from either class, plus
the share of a word among the document counts of the words of *all* documents, plus a mass for unknown words. Every
distribution sums to 1. What is stored of a model is what the discounts leave; all else has closed forms.

A text's evidence is the sum over its words of log P_toxic - log P_ordinary, less the mean of that over ordinary text, times the number of
words, over a power of that number. The step, the power and the logistic calibration are fitted on labelled rows that the
counts did not see.

Fitting takes at most ``MOST`` labelled rows of each class (a bounded sample, chosen by a hash of the id). The counts are of as many
rows of either, since continuation counts do not grow in proportion to text; a fifth and all rows that are left calibrate,
weighed by the classes' sizes. The ids of the
sample are broadcast, at 16 bytes each. The text of every document is scored whole.

Null texts are empty; an empty text has no evidence and gets the calibrated base rate. Rows with a null
id are scored, never learnt from. Repeated labels of an id count once, toxic winning; an id on several rows is learnt from
once, by its least text. An empty table gives an empty result; with labels of one class only (or none) every score is 0.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import chunks, crc_remainder, filter_rows, gathered, id_text, map_arrow, ship
from ripplemark.llm.labelled import bounded_sample

#: Labelled rows of each class that are learnt from.
MOST = 10_000
#: Steps of the discount that are tried.
STEPS = (1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)
#: Powers of the length that are tried.
POWERS = (0.25, 0.5, 0.75, 1.0)
#: Expressions that a task counts before it passes them on.
HELD = 300_000
#: Words of the labelled sample that are broadcast; beyond it the words of all documents are shuffled.
BROADCAST_WORDS = 2_000_000
WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Model:
    """Log-likelihood differences of words, heads and pairs, and the calibration.

    vocabulary: a number for each word that has an entry. single: for each, and last for all others; head: log of the ratio of the backoff masses
    after a word (0 for others); keys: sorted numbers first * size + second of the pairs that have an entry, in pairs.
    """

    def __init__(self, vocabulary: dict[str, int], single: np.ndarray, head: np.ndarray, keys: np.ndarray, pairs: np.ndarray):
        self.vocabulary, self.single, self.head, self.keys, self.pairs = vocabulary, single, head, keys, pairs
        self.rate, self.power, self.weight, self.bias = 0.0, 0.5, 0.0, -40.0

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Difference of log-likelihoods, toxic less ordinary, and number of words of each text."""
        size, number = len(self.vocabulary), self.vocabulary.get
        ids: list[int] = []
        ends = []
        for t in texts:
            ids.append(number("", size))
            ids += [number(w, size) for w in words_of(t)]
            ends.append(len(ids))
        v, bounds = np.array(ids, np.int64), np.array([0, *ends])
        gain = np.zeros(len(v))
        first, second = v[:-1], v[1:]
        gain[1:] = self.head[first] + self.single[second]
        if len(self.keys):
            key = np.where((first < size) & (second < size), first * size + second, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            gain[1:][hit] = self.pairs[at[hit]]
        gain[bounds[:-1]] = 0.0  # the start of a text is no word
        total = np.concatenate([[0.0], np.cumsum(gain)])
        return total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds) - 1

    def scores(self, texts: list[str]) -> np.ndarray:
        total, n = self.evidence(texts)
        x = self.bias + self.weight * (total - self.rate * n) / np.maximum(1, n) ** self.power
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


NOTHING = ({}, np.zeros(1), np.zeros(1), np.zeros(0, np.int64), np.zeros(0))


def discounts(t: np.ndarray, o: np.ndarray, n_t, n_o, step: float) -> tuple[np.ndarray, np.ndarray]:
    """What is taken from the counts t and o of the classes, whose sums are n_t and n_o."""
    alike = np.where((np.asarray(n_t) > 0) & (np.asarray(n_o) > 0), np.minimum(t / np.maximum(n_t, 1), o / np.maximum(n_o, 1)), 0.0)
    return np.minimum(t, alike * n_t + step * np.sqrt(t)), np.minimum(o, alike * n_o + step * np.sqrt(o))


def _discount(one: str, n_one: str | Column, other: str, n_other: str | Column, step: float) -> Column:
    """The same as a column, for the first of the classes."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (n_one, n_other))
    alike = F.when((a > 0) & (b > 0), F.least(F.col(one) / a, F.col(other) / b) * a).otherwise(F.lit(0.0))
    return F.least(F.col(one).cast("double"), alike + F.lit(step) * F.sqrt(one))


def word_model(t: np.ndarray, o: np.ndarray, share: np.ndarray, totals: dict, step: float) -> tuple[np.ndarray, np.ndarray]:
    """P of words in either class, from their counts and shares among all documents; last that of all unknown words together.

    totals: n_t, n_o (sums of the counts), and for the step l_t, l_o (backoff masses).
    """
    n_t, n_o, (l_t, l_o) = totals["n_t"], totals["n_o"], totals["masses"][step]
    d_t, d_o = discounts(t, o, n_t, n_o, step)
    unknown = 1 / min(n_t, n_o)
    shared = np.append(d_t / n_t + d_o / n_o + share, unknown) / (l_t + l_o + totals["corpus"] + unknown)
    return np.append((t - d_t) / n_t, 0.0) + l_t * shared, np.append((o - d_o) / n_o, 0.0) + l_o * shared


def assemble(words: pd.DataFrame, pairs: pd.DataFrame, heads: pd.DataFrame, totals: dict, step: float, vocabulary: dict[str, int]) -> Model:
    """A model of one step. words: word, t, o, share; pairs: first, second, t, o; heads: first, t, o, and l_t, l_o of this step.
    The models of all steps share the vocabulary, which is sent once."""
    size = len(vocabulary)
    at = words["word"].map(vocabulary).to_numpy(np.int64)
    p_t, p_o = word_model(words["t"].to_numpy(float), words["o"].to_numpy(float), words["share"].to_numpy(float), totals, step)
    single = np.full(size + 1, math.log(p_t[-1] / p_o[-1]))
    single[at] = np.log(p_t[:-1] / p_o[:-1])
    by_word = np.zeros((2, size))
    by_word[:, at] = p_t[:-1], p_o[:-1]
    head = np.zeros(size + 1)
    place = heads["first"].map(vocabulary).to_numpy(np.int64)
    n = np.zeros((2, size))
    n[:, place] = heads["t"], heads["o"]
    mass = np.ones((2, size))
    mass[:, place] = np.where(heads[["t", "o"]].to_numpy(float).T > 0, heads[["l_t", "l_o"]].to_numpy(float).T, 1.0)
    head[:-1] = np.log(mass[0] / mass[1])
    first, second = (pairs[c].map(vocabulary).to_numpy(np.int64) for c in ("first", "second"))
    counts = pairs[["t", "o"]].to_numpy(float).T
    taken = discounts(*counts, n[0][first], n[1][first], step)
    q_t, q_o = (np.where(n[c][first] > 0, (counts[c] - taken[c]) / np.maximum(n[c][first], 1), 0.0) + mass[c][first] * by_word[c][second] for c in (0, 1))
    keys = first * size + second
    order = np.argsort(keys)
    return Model(vocabulary, single, head, keys[order], np.log(q_t / q_o)[order])


def _triples(sample: DataFrame) -> DataFrame:
    """before, first, second, toxic: the word pairs of the sample with a hash of the word before them, once for each task."""

    def run(batches):
        seen: tuple[set, set] = (set(), set())

        def out():
            for toxic, held in enumerate(seen):
                if held:
                    before, first, second = zip(*held, strict=True)
                    before = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in before]
                    yield pa.RecordBatch.from_arrays([pa.array(before, pa.int64()), pa.array(first), pa.array(second), pa.array([toxic] * len(held), pa.int32())], ["before", "first", "second", "toxic"])
                    held.clear()

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = words_of(text or "")
                seen[int(toxic)].update(zip(["", "", *words], ["", *words], words))  # noqa: B905
            if sum(map(len, seen)) > HELD:
                yield from out()
        yield from out()

    return map_arrow(sample.select("text", "toxic"), run, "before long, first string, second string, toxic int")


def _document_counts(texts: DataFrame, of: DataFrame) -> DataFrame:
    """word, n: how many documents hold each of the words in ``of``, and, for the word null, the sum of that over all words.

    Counts are summed in each task before they are shuffled. Hashes of the words (8 bytes each) are broadcast where they are counted to be few
    enough; else all words are counted.
    """
    spark = texts.sparkSession
    few = of.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    shared = spark.sparkContext.broadcast(np.sort(gathered(of.select(F.xxhash64("word").alias("h")))["h"].to_numpy(np.int64)) if few else None)

    def run(batches):
        known, seen, total = shared.value, Counter(), 0

        def out():
            yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.string()), pa.array([*seen.values(), total], pa.int64())], ["word", "n"])
            seen.clear()

        for _, some in chunks(batches, "text"):
            sets = [set(words_of(text)) for text in some]
            total += sum(map(len, sets))
            if known is not None:
                words = list(set().union(*sets))
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)
                at = np.searchsorted(known, hashes)
                mine = set(itertools.compress(words, (known[np.minimum(at, len(known) - 1)] == hashes).tolist())) if len(known) else set()
                sets = [mine & words for words in sets]
            for words in sets:
                seen.update(words)
            if len(seen) > HELD:
                yield from out()
                total = 0
        yield from out()

    return map_arrow(texts.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_tables(documents: DataFrame, seen: DataFrame) -> list[Model]:
    """A model for each of STEPS from the labelled rows seen (text, toxic) and all documents; none if a class has no words."""
    flags = [F.max(F.when(F.col("toxic") == v, 1).otherwise(0)).alias(c) for c, v in (("t", 1), ("o", 0))]
    # one shuffle by the first word serves all sums over pairs and heads
    pairs = _triples(seen).repartition("first").groupBy("before", "first", "second").agg(*flags).groupBy("first", "second").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    head = Window.partitionBy("first")  # at most the words of the bounded sample
    whole = pairs.select("*", F.sum("t").over(head).alias("h_t"), F.sum("o").over(head).alias("h_o")).persist()
    counts = whole.groupBy("second").agg(*(F.sum((F.col(c) > 0).cast("int")).alias(c) for c in ("t", "o"))).withColumnRenamed("second", "word")
    everywhere = _document_counts(documents, counts.select("word")).persist()
    words = counts.join(everywhere, "word", "left").select("word", "t", "o", F.coalesce("n", F.lit(0)).alias("n")).persist()
    try:
        n_t, n_o = (int(x or 0) for x in words.agg(F.sum("t"), F.sum("o")).first())
        n = sum(r["n"] for r in everywhere.where("word is null").collect())
        if not n_t or not n_o:
            return []
        sizes = F.lit(float(n_t)), F.lit(float(n_o))
        taken = words.agg(*(F.sum(_discount(a, x, b, y, s)).alias(f"{a}{i}") for i, s in enumerate(STEPS) for a, x, b, y in (("t", sizes[0], "o", sizes[1]), ("o", sizes[1], "t", sizes[0])))).first()
        totals = {"n_t": n_t, "n_o": n_o, "corpus": 1.0 if n else 0.0, "masses": {s: (taken[f"t{i}"] / n_t, taken[f"o{i}"] / n_o) for i, s in enumerate(STEPS)}}

        left = (F.col("t") > _discount("t", "h_t", "o", "h_o", STEPS[0])) | (F.col("o") > _discount("o", "h_o", "t", "h_t", STEPS[0]))
        # what the least discount leaves: bounded by the words of the bounded sample over (least step) ** 2
        kept = gathered(whole.where(left).select("first", "second", "t", "o"))
        masses = whole.groupBy("first").agg(
            F.max(left).alias("stands"), F.max("h_t").alias("t"), F.max("h_o").alias("o"),
            *(F.sum(_discount(a, f"h_{a}", b, f"h_{b}", s)).alias(f"{a}{i}") for i, s in enumerate(STEPS) for a, b in (("t", "o"), ("o", "t"))),
        )
        heads = gathered(masses.where("stands").drop("stands"))
        stands = (F.col("t") > _discount("t", sizes[0], "o", sizes[1], STEPS[0])) | (F.col("o") > _discount("o", sizes[1], "t", sizes[0], STEPS[0]))
        wanted = words.where(stands).unionByName(words.join(whole.where(left).select(F.col("second").alias("word")).distinct(), "word", "left_semi")).distinct()
        own = gathered(wanted.withColumn("share", F.col("n") / F.lit(float(max(1, n)))))
    finally:
        whole.unpersist()
        words.unpersist()
        everywhere.unpersist()
    vocabulary = {w: i for i, w in enumerate(sorted({*own["word"], *heads["first"]}))}
    return [assemble(own, kept, heads.assign(l_t=heads[f"t{i}"] / heads["t"].clip(lower=1), l_o=heads[f"o{i}"] / heads["o"].clip(lower=1)), totals, s, vocabulary) for i, s in enumerate(STEPS)]


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """A model from labelled rows and the texts of all documents; labels: doc_id, toxic (0 or 1)."""
    spark = documents.sparkSession
    ship(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    chosen, sizes = bounded_sample(known, "toxic", most)
    if len(sizes) < 2:
        return Model(*NOTHING)
    even = bounded_sample(known, "toxic", most, balanced=True)[0].where(crc_remainder("doc_id", 5) != 4).select("doc_id", F.lit(True).alias("counted"))
    chosen = chosen.join(even, "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.coalesce("counted", F.lit(False)).alias("counted"))
    texts = id_text(documents)
    sample = texts.where("doc_id is not null and text is not null").join(F.broadcast(chosen), "doc_id")  # at most 2 x most ids
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("counted").alias("counted"))  # an id that many rows share counts once
    models = _word_tables(texts, sample.where("counted"))
    if not models:
        return Model(*NOTHING)
    shared = spark.sparkContext.broadcast(models)

    def measure(batches):
        for part, some in chunks(batches, "text"):
            found = [m.evidence(some) for m in shared.value]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(np.stack([x for x, _ in found], 1).tolist(), pa.list_(pa.float64())), pa.array(found[0][1], pa.int64())], ["toxic", "evidence", "n"])

    held = gathered(map_arrow(sample.where("not counted").select("toxic", "text"), measure, "toxic int, evidence array<double>, n long"))  # part of the bounded sample
    shared.destroy()
    y, n = held["toxic"].to_numpy(float), held["n"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        best = models[len(models) // 2]
        best.weight, best.bias = 1.0, math.log(sizes[1] / sizes[0])
        return best
    evidence = np.stack(held["evidence"].to_list())
    best, least = models[0], math.inf
    for i, m in enumerate(models):
        x = evidence[:, i]
        m.rate = float(x[y == 0].sum() / max(1.0, n[y == 0].sum()))
        m.power, m.weight, m.bias, loss = calibrate(y, x - m.rate * n, n, {c: float(k) for c, k in sizes.items()})
        if loss <= least:
            best, least = m, loss
    return best


def calibrate(y: np.ndarray, evidence: np.ndarray, n: np.ndarray, weight: dict[int, float]) -> tuple[float, float, float, float]:
    """Power of the length, weight and bias of the logistic calibration with the least loss, and that loss. weight: sizes of the classes."""
    w = np.where(y == 1, weight[1] / max(1, (y == 1).sum()), weight[0] / max(1, (y == 0).sum()))
    w = w / w.sum()
    ridge = max(1e-4, 0.5 / len(y))
    best = (math.inf, 0.5, 0.0, 0.0)
    for power in POWERS:
        x = evidence / np.maximum(1, n) ** power
        scale = x.std() or 1.0
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -40, 40)))
            v = w * p * (1 - p) + 1e-12
            g = np.array([(w * (p - y) * x / scale).sum() + ridge * a, (w * (p - y)).sum()])
            h = np.array([[(v * (x / scale) ** 2).sum() + ridge, (v * x / scale).sum()], [(v * x / scale).sum(), v.sum() + 1e-9]])
            d = np.linalg.solve(h, g)
            d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
            a, b = a - d[0], b - d[1]
            if np.abs(d).max() < 1e-8:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(a * x / scale + b, -40, 40))), 1e-9, 1 - 1e-9)
        loss = -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if loss < best[0] - 1e-6:
            best = (loss, power, a / scale, b)
    return *best[1:], best[0]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for part, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(texts), pa.float64())], ["doc_id", "score"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, score double")


def keep_ordinary(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below a half; all columns stay."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def decide():
        own = shared.value
        return lambda texts: (own.scores(texts) < 0.5).tolist()

    return filter_rows(df, decide, text_col)


def score_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labels whose crc32 of the id is not 0 modulo 5, and scores all documents."""
    remainder = crc_remainder("doc_id", 5)
    model = fit(documents, labels.where(remainder != 0))
    scored = predict(documents, model)
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

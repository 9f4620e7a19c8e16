"""Quality classification from overlapping heuristic labellers, without labels.

Labellers vote good, bad or nothing on a document from simple measures of its text. Expectation-
maximisation over the votes estimates how often each labeller is right on good and on bad documents,
and how common those are; all documents' votes count, summed to one row for each pattern of votes
(at most 3 to the number of labellers). The posteriors of the patterns then label a bounded sample of
documents, on which a linear scorer over hashed words, pairs of neighbouring words and measures is trained. The scorer
scores every whole text, every word whole.

Null texts are empty; a text without a word scores 0. Null and repeated ids are kept as they come, one
output row for each input row; rows with a null id are not trained on. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import chunks, id_text, map_arrow, ship
from ripplemark.llm.labelled import STEPS

#: Documents that the scorer is trained on, at most.
TRAIN_DOCS = 6_000
#: Buckets for hashed features.
BUCKETS = 1 << 18
#: Words whose buckets a worker remembers, of at most so many letters.
CACHE, SHORT = 100_000, 40
GOOD, BAD, NONE = 1, 0, -1
LETTERS = regex.compile(r"\p{L}+")


def measures(text: str) -> tuple[dict[str, float], list[str]]:
    """Simple measures of a text that the labellers vote on, and its tokens."""
    tokens = text.split()
    shaped = LETTERS.sub("a", text)
    n = max(1, len(tokens))
    top = max(Counter(tokens).values(), default=0)
    return {
        "tokens": len(tokens),
        "upper": sum(map(str.isupper, tokens)) / n,
        "letters": 1 - (len(shaped) - shaped.count("a")) / max(1, len(text)),
        "marks": sum(map(shaped.count, "#$%&*@~^=<>{}[]\\|_")) / n,
        "bang": shaped.count("!") / n,
        "bars": shaped.count("|") / n,
        "top": top / n if n >= 10 else 0.0,
        "runs": sum(map(eq, tokens, tokens[1:])) / n,
        "stops": (shaped.count(". ") + shaped.count(".\n") + shaped.endswith(".")) / n,
    }, tokens


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Name and vote of each labeller, from the measures.
LABELLERS: dict[str, Callable[[dict[str, float]], int]] = {
    "upper": lambda m: _vote(m["upper"] > 0.4, m["upper"] < 0.1),
    "marks": lambda m: _vote(m["marks"] > 0.25, m["marks"] < 0.03),
    "letters": lambda m: _vote(m["letters"] < 0.68, m["letters"] > 0.76),
    "bang": lambda m: _vote(m["bang"] > 0.15, m["bang"] < 0.01),
    "bars": lambda m: _vote(m["bars"] > 0.15, m["bars"] < 0.01),
    "top": lambda m: _vote(m["top"] > 0.2, m["top"] < 0.1),
    "runs": lambda m: _vote(m["runs"] > 0.05, m["runs"] < 0.02),
    "sentences": lambda m: _vote(m["tokens"] > 40 and m["stops"] < 0.01, m["stops"] > 0.03),
    "length": lambda m: _vote(m["tokens"] == 0, m["tokens"] > 20),
}


def votes(m: dict[str, float]) -> tuple[int, ...]:
    return tuple(f(m) for f in LABELLERS.values())


def fit_votes(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of good for each pattern of votes, and chance of each vote: labeller x class x (bad, good, none).

    The class names are fixed by the start, a majority vote.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((0, 2, 3))
    v, n = np.array(names), np.array([patterns[k] for k in names], float)
    bad, good = (v == BAD).sum(axis=1), (v == GOOD).sum(axis=1)
    post = (good + 1.0) / (good + 3.0 * bad + 2.0)  # a bad vote says more than a good one
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        chance = np.empty((v.shape[1], 2, 3))
        for k in range(v.shape[1]):
            for vote in (BAD, GOOD, NONE):
                chance[k, :, vote] = weight[:, v[:, k] == vote].sum(axis=1) + 0.5
            chance[k] /= chance[k].sum(axis=1, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(chance[k][:, v[:, k]]) for k in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, post = np.abs(new - post).max() < 1e-7, new
        if done:
            break
    return dict(zip(names, post.tolist(), strict=True)), chance


class _Buckets(dict):
    """Hashes of words; short ones are remembered."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


_HASH = _Buckets()


def features(m: dict[str, float], tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: its words and pairs of words by the root of their share, and its measures in steps."""
    words = np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (words[:-1] * np.uint64(0x9E3779B1) + words[1:]) >> np.uint64(7)
    parts = []
    for some in (words, pairs):
        if len(some):
            at, n = np.unique((some % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
            parts.append((at, np.sqrt(n / len(some))))
    steps = [f"{name}:{int(10 * math.sqrt(min(1.0, x))) if name != 'tokens' else int(math.log2(1 + x))}" for name, x in m.items()]
    parts.append((np.array([zlib.crc32(k.encode()) % BUCKETS for k in [*steps, "bias"]], np.int64), np.ones(len(m) + 1)))
    at, place = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
    return at, np.bincount(place, np.concatenate([x for _, x in parts]))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 12, rate: float = 0.5) -> np.ndarray:
    """Weights of the linear scorer: logistic loss against soft labels, adaptive steps."""
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    for _ in range(rounds):
        for at, x, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ x)))))
            g = (p - y) * x + 1e-6 * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
    return w


def score_text(text: str, w: np.ndarray) -> float:
    m, tokens = measures(text)
    if not tokens:
        return 0.0
    at, x = features(m, tokens)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ x)))))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> tuple[np.ndarray, dict]:
    """Weights of the scorer, and the posteriors of the vote patterns."""
    ship(df.sparkSession)
    rows = id_text(df, id_col, text_col)

    def vote(batches):
        seen: Counter = Counter()
        for _, texts in chunks(batches, "text"):
            seen.update(votes(measures(t)[0]) for t in texts)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    counted = map_arrow(rows, vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    patterns = {tuple(r["votes"]): r["n"] for r in counted.collect()}  # at most 3 ** labellers rows
    post, _ = fit_votes(patterns)
    n = sum(patterns.values())
    share = min(STEPS, STEPS * most // max(1, n) + 1)
    sample = rows.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(STEPS)) < share))
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"))  # an id that many rows share counts once

    def prepare(batches):
        for part, texts in chunks(batches, "text"):
            ms = [measures(t) for t in texts]
            made = [features(*m) for m in ms]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary()), pa.array([post.get(votes(m), 0.5) for m, _ in ms], pa.float64())],
                ["doc_id", "at", "x", "y"],
            )

    kept = map_arrow(sample, prepare, "doc_id long, at binary, x binary, y double").collect()  # the bounded sample
    kept.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), r["y"]) for r in kept]), post


def predict(df: DataFrame, w: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (1: good) for every row."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(w)  # BUCKETS numbers

    def run(batches):
        for part, texts in chunks(batches, "text"):
            found = [score_text(t, shared.value) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], ["doc_id", "score", "predicted"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, score double, predicted int")


def classify(df: DataFrame) -> DataFrame:
    """doc_id, score, predicted: learns from the table's own texts and scores all of them."""
    w, _ = fit(df)
    return predict(df, w)

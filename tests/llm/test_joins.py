from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ripplemark.llm import jaccard, neighbours
from ripplemark.llm.common import Scratch
from ripplemark.llm.components import _star, components
from ripplemark.llm.shingles import shingle_sets


def brute_sets(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [brute_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def texts_with_copies(rng, n_groups=12, copies=14, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    passage = [rng.choice(vocabulary) for _ in range(55)]
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if g % 4 == 0:
                t = t[:20] + passage
            out.append(" ".join(t))
    out += ["", " \n\t", "One Two", "one two", "one  two\x0b", "a b c d e", "A B C D E f", "é É", "x"]
    rng.shuffle(out)
    return out


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    return [rows[i] for i in range(len(texts))]


def test_hashing_equals_sets():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abA é\n\t ") for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", " "]
    seen = {}
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        want = brute_sets(t)
        assert len(s) == len(want)
        assert seen.setdefault(frozenset(want), s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_sketches_never_reject_similar_sets():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for drop in (0, n // 20, n // 10):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop // 2).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= 80 * (len(a) + len(b) - shared):
                assert not jaccard.far_apart(jaccard.sketch(a), jaccard.sketch(b), len(a), len(b))
    assert jaccard.far_apart(jaccard.sketch(rng.integers(0, 2**63, 300).astype(np.uint64)), jaccard.sketch(rng.integers(0, 2**63, 300).astype(np.uint64)), 300, 300)


def test_prefix_is_long_enough():
    for n in range(1, 400):
        least = -(-80 * n // 100)
        assert jaccard.prefix_length(n) + least == n + 1


def test_components_equal_brute_force(spark):
    texts = texts_with_copies(random.Random(1))
    assert run(spark, texts) == brute_components(texts)


def test_blocks_and_random_neighbours(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BIG", 4)
    monkeypatch.setattr(jaccard, "MANY_OPEN", 0)
    texts = texts_with_copies(random.Random(2), copies=20)
    assert run(spark, texts) == brute_components(texts)


def test_salted_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REPORTED", 2)
    monkeypatch.setattr(jaccard, "SALTED", 3)
    texts = texts_with_copies(random.Random(3), n_groups=6, copies=25)
    assert run(spark, texts) == brute_components(texts)


def test_salted_shingle_with_one_class_in_its_first_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REPORTED", 0)
    monkeypatch.setattr(jaccard, "SALTED", 3)
    passage = " ".join(f"p{i}" for i in range(100))
    long = [f"{passage} " + " ".join(f"l{k}x{i}" for i in range(500)) for k in range(6)]  # the passage is in no prefix of these
    by = {}
    for k in range(40):  # 8 texts hold the passage, so its shingles have 3 salts
        t = f"{passage} " + " ".join(f"s{k}x{i}" for i in range(10))
        by.setdefault((jaccard.set_key(shingle_sets([t])[0]) & 0x7FFFFFFF) % 3, t)
    texts = [by[0], by[1], *long]
    assert brute_components(texts)[1][1] == 0
    assert run(spark, texts) == brute_components(texts)


def test_nulls_and_repeats(spark):
    rows = [(5, "a b c d e f", 1), (None, "a b c d e f", 1), (3, None, 1), (7, "", 1), (7, "a b c d e f", 1), (9, "z " * 60_000, 1), (10, "z " * 60_001, 1), (None, "alone here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()), key=repr)
    want = [(5, 2, 5), (None, 2, 5), (3, 0, 3), (7, 0, 7), (7, 2, 5), (9, 1, 9), (10, 1, 9), (None, 1, None)]
    assert got == sorted(want, key=repr)
    assert jaccard.near_duplicates(df.where("false")).count() == 0
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted([(5, "a b c d e f"), (3, None), (7, ""), (9, "z " * 60_000), (None, "alone here")], key=repr)
    again = df.union(df).union(spark.createDataFrame([(5, "q r s t u v", 1), (8, "q r s t u v", 1)], df.schema))
    kept = sorted((tuple(r)[:2] for r in jaccard.keep_first(again).collect()), key=repr)
    once = [(5, "a b c d e f"), (9, "z " * 60_000), (None, "alone here"), (5, "q r s t u v")]
    assert kept == sorted(once + 2 * [(3, None), (7, "")], key=repr)


def test_blocks_of_a_hot_shingle_meet_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BIG", 4)
    monkeypatch.setattr(jaccard, "MANY_OPEN", 10**9)
    monkeypatch.setattr(jaccard, "TASK_BLOCKS", 1)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(passage + [f"t{k}x{i}" for i in range(rng.choice([3, 4, 6, 9]))]) for k in range(400)]
    assert run(spark, texts) == brute_components(texts)


def test_forest_and_stars(spark, monkeypatch):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(40)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}
    scratch = Scratch(spark, "test")
    assert {r["node"]: r["component"] for r in components(df, scratch, "one").collect()} == want
    import ripplemark.llm.components as module

    monkeypatch.setattr(module, "PART", 20)
    assert {r["node"]: r["component"] for r in components(df, scratch, "many").collect()} == want
    assert components(df.where("false"), scratch, "none").count() == 0
    assert _star(df.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v"), True).count() > 0


# -- nearest neighbours --


def brute_neighbours(rows, k=20, every=20):
    out = set()
    for i, (q, x) in enumerate(rows):
        if q % every:
            continue
        found = []
        for j, (v, y) in enumerate(rows):
            if j != i:
                s = 0.0
                for a, b in zip(x, y, strict=True):
                    s += a * b
                found.append((-s, v))
        for rank, (s, v) in enumerate(sorted(found)[:k], 1):
            out.add((q, rank, v, round(-s, 12)))
    return out


def search(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in neighbours.search(df, **more).collect()}


@pytest.mark.parametrize("clustered", [False, True])
def test_search_is_exact(spark, clustered):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * (6 if clustered else 0)
    rows = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    assert search(spark, [(*r, 1) for r in rows]) == brute_neighbours(rows)


def test_search_edge_cases(spark):
    good = [(i, [float(i + 1), 1.0]) for i in range(0, 30)]
    odd = [(40, None), (41, [0.0, 0.0]), (42, [None, 1.0]), (43, [float("nan"), 1.0]), (44, [float("inf"), 1.0]), (45, [1.0]), (None, [1.0, 1.0]), (46, [])]
    got = search(spark, [(*r, 1) for r in good + odd])
    assert got == brute_neighbours(good)
    assert search(spark, [(20, [1.0, 2.0], 1)]) == set()
    assert search(spark, [(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1)]) == {(20, 1, 20, 5.0)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.search(empty).count() == 0


def test_hilbert_steps_are_neighbours():
    for d, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        keys = neighbours.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**d))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(5)
    short, long = ([(i, rng.normal(size=d).tolist()) for i in range(a, b)] for d, a, b in ((3, 0, 60), (5, 60, 150)))
    want = brute_neighbours(short) | brute_neighbours(long)
    assert search(spark, [(*r, 1) for r in short + long]) == want


def test_grid_copies_least():
    assert neighbours.grid(100, 5) == (1, 1)
    down, across = neighbours.grid(10**9, 5 * 10**7)
    cells = 10**9 * 5 * 10**7 // neighbours.CELL
    assert 0.9 < down * across / cells < 1.2
    copies = 10**9 * across + 5 * 10**7 * down
    assert copies <= 1.01 * min(10**9 * -(-cells // d) + 5 * 10**7 * d for d in range(1_000, 200_000, 500))


def test_cells_of_a_grid_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "CELLS", 40)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(700)]
    assert neighbours.grid(700, 35)[0] > 4
    assert search(spark, [(*r, 1) for r in rows]) == brute_neighbours(rows)

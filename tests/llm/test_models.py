from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from ripplemark.llm import labelled, langid, quality, queries, toxicity
from ripplemark.llm.common import documents


def brute_segmentations(pieces, symbols):
    """All lists of pieces that spell the symbols."""
    number = {n: i for i, n in enumerate(pieces.names)}

    def ways(rest):
        if not rest:
            return [[]]
        return [[number[rest[:k]], *more] for k in range(1, len(rest) + 1) if rest[:k] in number for more in ways(rest[k:])]

    return ways(tuple(symbols))


def test_forward_and_uses_equal_all_segmentations():
    pieces = langid.pieces_of(queries.PIECES)
    rng = np.random.default_rng(0)
    p = rng.random((2, pieces.size))
    p /= p.sum(axis=1, keepdims=True)
    words = ["the", "x", "anthé", "日本x", "internation", "ሀሁ"]
    weights = rng.random((len(words), 2))
    uses, want_uses, seen = np.zeros((2, pieces.size)), np.zeros((2, pieces.size)), set()
    for places, lattice in pieces.batches(words):
        got = lattice.totals(np.log(p).T)
        more, _ = lattice.uses(np.log(p).T, weights[places], pieces.size)
        uses += more
        for row, i in enumerate(places):
            seen.add(i)
            ways = brute_segmentations(pieces, pieces.symbols(words[i]))
            chance = np.array([np.prod(p[:, w], axis=1) for w in ways])
            np.testing.assert_allclose(got[row], np.log(chance.sum(axis=0)), rtol=1e-9)
            for w, c in zip(ways, chance / chance.sum(axis=0), strict=True):
                for k in w:
                    want_uses[:, k] += c * weights[i]
    assert seen == set(range(len(words)))
    np.testing.assert_allclose(uses, want_uses, atol=1e-9)
    assert pieces.longest > 12 and any(len(w) == pieces.longest for w in pieces.names)


def test_probabilities_sum_to_one_and_likelihood_grows():
    pieces = langid.pieces_of(queries.PIECES)
    words = ["the", "house", "garden", "das", "haus", "garten"]
    weights = np.array([[3.0, 0]] * 3 + [[0, 2.0]] * 3)
    p, last = np.tile(pieces.start, (2, 1)), -np.inf
    for _ in range(6):
        uses, likelihood = np.zeros((2, pieces.size)), 0.0
        for places, lattice in pieces.batches(words):
            more, gain = lattice.uses(np.log(p).T, weights[places], pieces.size)
            uses, likelihood = uses + more, likelihood + gain
        assert likelihood > last - 1e-6
        p, last = langid.smoothed(uses, pieces.start), likelihood
        np.testing.assert_allclose(p.sum(axis=1), 1)


def test_long_words_of_unseen_letters_have_a_score():
    pieces = langid.pieces_of(queries.PIECES)
    p = np.stack([pieces.start, pieces.start[::-1]])
    scorer = langid.Scorer(pieces, ["a", "b"], p / p.sum(axis=1, keepdims=True))
    texts = ["ሀ" * 20, "ሀ" * 10_000 + " the house", "the " * 300, "x" * 50_000, "ሀ" * 19 + " " + "the house and garden " * 20, "̈́", "1 2 ."]
    found = scorer.score(texts)
    assert [lang for lang, _ in found[-2:]] == ["und", "und"]
    for lang, score in found[:-2]:
        assert lang in ("a", "b") and 0.5 <= score <= 1
    # a long word is one word: its probability is that of its segmentations, not of parts
    (_, one), *_ = pieces.batches(["understanding"])
    whole = one.totals(scorer.logs)[0]
    ways = brute_segmentations(pieces, pieces.symbols("understanding"))
    np.testing.assert_allclose(whole, np.log(np.array([np.prod(np.exp(scorer.logs[w]), axis=0) for w in ways]).sum(axis=0)), rtol=1e-9)


def test_languages(spark, data):
    docs = documents(spark, data)
    rows = langid.identify(docs, queries.PIECES).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.95


def test_language_edge_cases(spark):
    rows = [(i, t, g, "s") for i, (t, g) in enumerate([("the house and the dog", "en"), ("das haus und der hund", "de")] * 20)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 .. ²", None, "s"), (None, "the dog", "en", "s"), (103, "the dog " + "q" * 500, None, "s"), (104, "ሀ" * 10_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df, queries.PIECES).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[None]["lang_pred"] == "en" and got[103]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(df.where("false"), queries.PIECES).count() == 0
    nothing = langid.identify(df.withColumn("lang", df["lang"].substr(1, 0)).where("doc_id = 0"), queries.PIECES).collect()
    assert len(nothing) == 1
    model = langid.fit(df, queries.PIECES)
    kept = langid.keep_known(df, queries.PIECES, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(40)) | {None, 103, 104}


def toxic_table(spark):
    rng = np.random.default_rng(0)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    words = [w.replace("w", "") + "x" for w in words]
    rows, labels = [], []
    for i in range(900):
        t = [words[j] for j in rng.integers(0, len(words), 60)]
        bad = i % 6 == 0
        if bad:
            for j in rng.integers(0, 60, 3):
                t[j] = "vilewort"
        rows.append((i, " ".join(t), "en", "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "vilewort vilewort vilewort", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_table(spark)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(spark, docs, labels).collect()}
    assert len(rows) == 903
    unseen = [r for d, r in rows.items() if d is not None and d < 900 and (d % 2 or zlib.crc32(str(d).encode()) % 5 == 0)]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in unseen) / len(unseen) > 0.97
    assert rows[None]["predicted"] == 1 and rows[1001]["predicted"] == 0 and rows[1000]["score"] == rows[1001]["score"]
    kept = toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.where("text like '%vilewort%'").count() < 5
    none = toxicity.score_documents(spark, docs, labels.where("toxic = 0")).collect()
    assert len(none) == 903 and max(r["score"] for r in none) < 1e-6
    assert toxicity.score_documents(spark, docs.where("false"), labels).count() == 0


def test_copies_do_not_make_a_word_toxic(spark):
    docs, labels = toxic_table(spark)
    extra = [(2000 + i, "copied passage about gardens in spring", "en", "s") for i in range(300)]
    more = spark.createDataFrame([(2000 + i, 1, 1) for i in range(300)], labels.schema)
    model = toxicity.fit(docs.union(spark.createDataFrame(extra, docs.schema)), labels.union(more))
    assert "gardens" not in model.vocabulary


def brute_model(texts, everywhere, step):
    """P(word, head, class) of the model's definition, from sets; and its words."""
    contexts = [set(), set()]
    for text, toxic in texts:
        w = toxicity.words_of(text)
        contexts[toxic].update(zip(["", "", *w], ["", *w], w))  # noqa: B905
    pairs = [Counter((b, c) for _, b, c in held) for held in contexts]
    words = [Counter(b for _, b in p) for p in pairs]
    documents = Counter(w for t in everywhere for w in set(toxicity.words_of(t)))
    known = set(documents) | set(words[0]) | set(words[1])

    def taken(counts, sums, cls):
        both = min(c / n for c, n in zip(counts, sums, strict=True)) if all(sums) else 0
        return min(counts[cls], both * sums[cls] + step * counts[cls] ** 0.5)

    sums = [sum(c.values()) for c in words]
    d = [{w: taken([words[0][w], words[1][w]], sums, c) for w in known} for c in (0, 1)]
    mass = [sum(d[c].values()) / sums[c] for c in (0, 1)]
    unknown = 1 / min(sums)
    total = sum(mass) + 1 + unknown

    def single(w, c):
        if w not in known:
            return mass[c] * unknown / total
        return (words[c][w] - d[c][w]) / sums[c] + mass[c] * (d[0][w] / sums[0] + d[1][w] / sums[1] + documents[w] / sum(documents.values())) / total

    heads = [Counter() for _ in (0, 1)]
    for c in (0, 1):
        for (v, _), n in pairs[c].items():
            heads[c][v] += n

    def conditional(w, v, c):
        n = [heads[0][v], heads[1][v]]
        if not n[c]:
            return single(w, c)
        left = sum(taken([pairs[0][v, x], pairs[1][v, x]], n, c) for x in known) / n[c]
        return (pairs[c][v, w] - taken([pairs[0][v, w], pairs[1][v, w]], n, c)) / n[c] + left * single(w, c)

    return conditional, known


def test_kneser_ney_equals_brute_force_and_sums_to_one(spark):
    rng = np.random.default_rng(3)
    words = ["".join(w) for w in itertools.product("abc", repeat=2)]
    texts = [(" ".join(rng.choice(words, 30, p=np.arange(1, 10) / 45)) + (" vile wort" * 3 if i % 2 else ""), i % 2) for i in range(60)]
    everywhere = [t for t, _ in texts] + ["aa bb unlabelled words", "", "aa aa"]
    models = toxicity._word_tables(spark.createDataFrame([(t,) for t in everywhere], "text string"), spark.createDataFrame(texts, "text string, toxic int"))
    assert len(models) == len(toxicity.STEPS)
    for step, model in list(zip(toxicity.STEPS, models, strict=True))[:3]:
        p, known = brute_model(texts, everywhere, step)
        for v in ("", "aa", "vile", "unlabelled", "never"):
            for c in (0, 1):
                assert sum(p(w, v, c) for w in [*known, "never"]) == pytest.approx(1)
        some = ["aa ab never vile wort wort unlabelled cc", "", "vile wort", texts[1][0]]
        got, n = model.evidence(some)
        for t, g, k in zip(some, got, n, strict=True):
            w = toxicity.words_of(t)
            want = sum(np.log(p(x, v, 1) / p(x, v, 0)) for v, x in zip(["", *w], w))  # noqa: B905
            assert k == len(w) and g == pytest.approx(want, abs=1e-9)


def test_a_pair_alike_in_both_classes_is_no_evidence(spark):
    texts = [(f"w{chr(97 + i % 26)}x san francisco", 1) for i in range(26)] + [("the san francisco", 0), ("a san francisco", 0), ("in san francisco", 0)]
    model = toxicity._word_tables(spark.createDataFrame([(t,) for t, _ in texts], "text string"), spark.createDataFrame(texts, "text string, toxic int"))[0]
    alone, both = model.evidence(["san", "san francisco"])[0]
    assert abs(both - alone) < 0.5


def test_a_dozen_toxic_labels(spark):
    docs, labels = toxic_table(spark)
    few = labels.where("toxic = 0 and doc_id < 200 or toxic = 1 and doc_id < 72")
    assert few.where("toxic = 1").count() == 12
    rows = toxicity.score_documents(spark, docs, few).collect()
    clean = [r["predicted"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 6]
    bad = [r["predicted"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 6 == 0]
    assert sum(clean) / len(clean) < 0.1 and sum(bad) / len(bad) > sum(clean) / len(clean)
    long = spark.createDataFrame([(1, "vilewort " * 200_000), (1, None), (2, "word " * 200_000)], "doc_id long, text string")
    assert toxicity.predict(long, toxicity.fit(docs, labels)).count() == 3


def test_quality_em_and_scorer(spark, data):
    docs = documents(spark, data)
    rows = {r["doc_id"]: r["predicted"] for r in quality.classify(docs).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    right = [rows[d] == q for d, q in labels.items()]
    assert sum(right) / len(right) > 0.93
    edge = spark.createDataFrame([(1, None), (2, ""), (None, "Some words here."), (3, "x " * 40_000)], "doc_id long, text string")
    assert quality.predict(edge, np.zeros(quality.BUCKETS)).count() == 4
    assert quality.classify(edge.where("false")).count() == 0


def test_quality_features_are_whole_words_and_pairs():
    def of(text):
        return quality.features(*quality.measures(text))

    import codecs

    one, other = of("some ordinary words stand here"), of(codecs.encode("some ordinary words stand here", "rot13"))
    assert set(one[0].tolist()) != set(other[0].tolist())
    long = "x" * 500
    assert set(of(long + "a")[0].tolist()) != set(of(long + "b")[0].tolist())
    assert set(of("a b c")[0].tolist()) != set(of("c b a")[0].tolist())
    at, x = of("red red blue")
    assert len(set(at.tolist())) == len(at) == len(x)
    assert x[at == zlib.crc32(b"red") % quality.BUCKETS][0] == pytest.approx((2 / 3) ** 0.5)


def test_quality_edge_cases(spark):
    good = "This is a sentence of words that any one may read. It has more than one part, and ends well."
    rows = [(i, f"{good} Number {i}.", "x", 1) for i in range(60)] + [(i, "$$ ## | | !! !! BUY NOW BUY NOW", "x", 1) for i in range(60, 90)]
    rows += [(1, None, None, None), (1, good, None, 2), (None, good, None, 3), (95, "", "y", 4), (96, "w " * 100_000, "y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    got = quality.classify(df)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows)
    by = {r["doc_id"]: r["predicted"] for r in got.collect() if r["doc_id"] != 1}
    assert all(by[i] == 1 for i in range(2, 60)) and not any(by[i] for i in range(60, 90)) and by[None] == 1 and by[95] == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7]
    votes = [tuple(int(t) if rng.random() < r else int(not t) for r in right) for t in truth]
    post, chance = quality.fit_votes(Counter(votes))
    guess = [post[v] >= 0.5 for v in votes]
    assert np.mean(np.array(guess) == truth) > 0.94
    np.testing.assert_allclose(chance[:, 1, 1], right, atol=0.06)
    assert quality.fit_votes({})[0] == {}


def test_bounded_sample(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 100 = 0 THEN 'rare' ELSE 'often' END AS g").union(spark.createDataFrame([(None, "often"), (1, None)], "doc_id long, g string"))
    sample, sizes = labelled.bounded_sample(df, "g", 1000)
    n = {r["g"]: r["count"] for r in sample.groupBy("g").count().collect()}
    assert sizes == {"rare": 200, "often": 19_800} and n["rare"] == 200 and 800 < n["often"] < 1200
    assert labelled.bounded_sample(df.where("false"), "g", 10)[1] == {}

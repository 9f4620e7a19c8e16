from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplemark.functions import scalars as C
from ripplemark.functions.fingerprints import array_digest, canonical_json, table_digest
from ripplemark.operators import dense as B
from ripplemark.operators import estimators as E
from ripplemark.operators import picks as P
from ripplemark.plans.model import level_name
from ripplemark.sources import files
from ripplemark.sources.publish import Artifact, json_artifact, publish, publish_tables, table_artifact


def packed(spark, signals):
    rows = [(r, int(f), [float(v) for v in y[:, f]]) for r, y in signals.items() for f in range(y.shape[1])]
    return spark.createDataFrame(rows, "run int, feature int, y array<double>")


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(1)
    designs = {r: np.column_stack([rng.normal(size=(40 + r, 2)), np.ones(40 + r)]) for r in range(3)}
    signals = {r: x @ rng.normal(size=(3, 9)) + rng.normal(size=(len(x), 9)) for r, x in designs.items()}
    signals[1][:, 4] = 3.0
    return designs, signals


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_blocks_do_not_change_results(spark, problem, block):
    designs, signals = problem
    c = dict.fromkeys(designs, np.array([1.0, -1.0, 0.0]))
    rows = {r["feature"]: r for r in B.fit_glm(packed(spark, signals), designs, {"c": c}, block=block).collect()}
    want = E.combine_runs([E.fit_run(signals[r], designs[r], np.array([c[r]])) for r in range(3)])
    for f in range(9):
        if f == 4:
            assert rows[f]["effect"] is None and rows[f]["t"] is None and rows[f]["r2"] is not None
        else:
            assert rows[f]["t"] == pytest.approx(want["t"][0, f]) and rows[f]["p"] == pytest.approx(want["p"][0, f])


def test_ragged_or_missing_features_raise(spark, problem):
    designs, signals = problem
    bad = packed(spark, signals).where("not (run = 0 and feature = 2)")
    with pytest.raises(Exception, match="every run holds every feature"):
        B.run_effects(bad, designs, dict.fromkeys(designs, np.array([1.0, 0, 0]))).collect()


def test_held_out_runs_do_not_change_selection_in_training(spark, problem):
    _, signals = problem
    rng = np.random.default_rng(4)
    runs = {r: E.candidate_run(np.ones((len(y), 1)), [rng.normal(size=(len(y), 1)) for _ in range(4)]) for r, y in signals.items()}
    one = B.candidate_scores(packed(spark, {0: signals[0], 1: signals[1]}), {r: runs[r] for r in (0, 1)}, [0], [1]).collect()
    two = B.candidate_scores(packed(spark, signals | {2: signals[2] * 50}), runs, [0], [1]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_empty_and_tied_picks(spark):
    df = spark.createDataFrame([("f", 2, 0.5), ("f", 1, 0.5), ("g", 1, None)], "feature string, id int, score double")
    assert [tuple(r) for r in P.best_candidate(df, ["feature"], "id", "score").collect()] == [("f", 1, 0.5)]
    assert [tuple(r) for r in P.best_fraction(df, ["feature"], "id", "score").collect()] == [("f", 2, 0.5)]
    assert P.best_candidate(df.where("false"), ["feature"], "id", "score").count() == 0
    two = P.two_best(df, ["feature"], "id", "score").collect()
    assert (two[0]["id"], two[0]["runner_up"], two[0]["gap"]) == (1, 2, 0.0)


def test_count_walk(spark):
    def choose(*scores):
        df = spark.createDataFrame([("k", i, s) for i, s in enumerate(scores)], "k string, n int, s double")
        return [r["n"] for r in P.first_good_enough(df, ["k"], "n", "s").collect()]

    assert choose(0.1, 0.3, 0.305, 0.2) == [1]
    assert choose(0.1, None, 0.3, 0.5) == [3]
    assert choose(0.4, 0.3, 0.2) == [0]
    assert choose(None, 0.3) == []


def test_level_columns_match_python(spark):
    values = ["1", "1.0", " 2 ", "x", "", "n/a", "NaN", None, "2.5", "1e2", "-3.0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(C.level_name(F.col("v"))).collect()]
    assert got == [level_name(v) for v in values]
    with pytest.raises(Exception, match="infinite"):
        spark.createDataFrame([("inf",)], "v string").select(C.level_name(F.col("v"))).collect()
    with pytest.raises(ValueError):
        C.indicators(F.col("v"), "v", ["a"])


def test_table_digest_ignores_order(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k int, v string")
    one = table_digest(df, ["k", "v"]).first()
    two = table_digest(df.orderBy(F.desc("k")).repartition(3), ["k", "v"]).first()
    other = table_digest(df.withColumn("v", F.when(F.col("k") == 7, "w").otherwise(F.col("v"))), ["k", "v"]).first()
    assert one == two and one != other and one["rows"] == 50
    assert array_digest(np.arange(4)) != array_digest(np.arange(4).reshape(2, 2))
    assert canonical_json({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    with pytest.raises(ValueError):
        canonical_json(float("nan"))


def test_publish_is_all_or_nothing(tmp_path, monkeypatch):
    publish(tmp_path, [json_artifact("a.json", {"v": 1}), Artifact("d/b.txt", b"one")], manifest="manifest.json")
    assert json.loads((tmp_path / "a.json").read_text()) == {"v": 1}
    with pytest.raises(FileExistsError):
        publish(tmp_path, [Artifact("a.json", b"x")])
    real, calls = os.replace, []

    def failing(src, dst):
        calls.append(dst)
        if str(dst).endswith("z.txt") and "new" in str(src):
            raise OSError("full")
        return real(src, dst)

    monkeypatch.setattr(os, "replace", failing)
    with pytest.raises(OSError):
        publish(tmp_path, [Artifact("a.json", b"x"), Artifact("z.txt", b"z")], overwrite=True, manifest="manifest.json")
    monkeypatch.setattr(os, "replace", real)
    assert json.loads((tmp_path / "a.json").read_text()) == {"v": 1} and (tmp_path / "d/b.txt").exists()
    publish(tmp_path, [Artifact("a.json", b"new")], overwrite=True, manifest="manifest.json")
    assert (tmp_path / "a.json").read_bytes() == b"new" and not (tmp_path / "d/b.txt").exists()
    assert table_artifact("t.tsv", ["a"], [[None], [1.5]]).data == b"a\nn/a\n1.5\n"
    for bad in ("/x", "a/../b", "", "a//b"):
        with pytest.raises(ValueError):
            Artifact(bad, b"")


def test_publish_tables(spark, tmp_path):
    df = spark.range(5)
    publish_tables(spark, str(tmp_path), {"one": df, "two": df})
    assert spark.read.parquet(f"{tmp_path}/two").count() == 5
    with pytest.raises(FileExistsError):
        publish_tables(spark, str(tmp_path), {"one": df})
    with pytest.raises(Exception):
        publish_tables(spark, str(tmp_path), {"one": spark.range(9), "bad": df.select(F.raise_error(F.lit("no")).cast("int").alias("x"))}, overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/one").count() == 5


def test_files(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("onset\tduration\ttrial_type\tresponse_time\n9\t1\ta\tn/a\n2\t0\tb\t0.4\n")
    rows = files.read_events(spark, str(tmp_path / "e.tsv")).orderBy("event_index").collect()
    assert [(r["onset"], r["response_time"]) for r in rows] == [(2.0, 0.4), (9.0, None)]
    (tmp_path / "s.json").write_text('{"RepetitionTime": 1.6,\n "StartTime": 0.775}')
    assert files.read_sidecar(spark, str(tmp_path / "s.json"), "RepetitionTime double, StartTime double").first()["StartTime"] == 0.775
    assert files.frame_times(3, 1.6, 0.775).tolist() == pytest.approx([0.775, 2.375, 3.975])
    with pytest.raises(ValueError):
        files.frame_times(3, 1.6, stated=2.0)
    columns = [b + s for b in files.MOTION for s in ("", "_derivative1", "_power2", "_derivative1_power2")] + [f"a_comp_cor_{i:02d}" for i in range(8)] + ["cosine00", "junk"]
    meta = {f"a_comp_cor_{i:02d}": {"VarianceExplained": i, "Retained": i != 7, "Mask": "combined"} for i in range(8)}
    names = files.confound_names(columns, meta)
    assert names[24:] == [f"a_comp_cor_{i:02d}" for i in (6, 5, 4, 3, 2, 1)] + ["cosine00"]


def test_workflow(spark, tmp_path, monkeypatch):
    from ripplemark import workflow
    from ripplemark.plans.kernels import Library
    from ripplemark.plans.model import Modulator
    from ripplemark.plans.settings import Settings

    rng = np.random.default_rng(2)
    for r in (1, 2, 3):
        onset = 4 + 9.0 * np.arange(8)
        rt = rng.uniform(0.3, 1.0, 8)
        pd.DataFrame({"onset": onset, "duration": 1.0, "trial_type": ["a", "b"] * 4, "response_time": rt}).to_csv(tmp_path / f"sub-1_ses-a_task-t_run-{r}_events.tsv", sep="\t", index=False)
        rows = [(s, 1.0 * s, f, float(rng.normal())) for s in range(90) for f in range(3)]
        spark.createDataFrame(rows, "scan int, t double, feature int, y double").coalesce(1).write.parquet(str(tmp_path / "in" / f"run{r}"))
        part = next((tmp_path / "in" / f"run{r}").glob("part-*.parquet"))
        os.replace(part, tmp_path / f"sub-1_ses-a_task-t_run-{r}_signal.parquet")
    import shutil

    shutil.rmtree(tmp_path / "in")
    s = Settings(str(tmp_path), "1", "a", "t", output_dir=str(tmp_path / "out"), modulators=(Modulator("response_time"),))
    record = workflow.run(spark, s, Library.of([(5.0, 16.0, 1.0, 1.0, 6.0, 0.0, 32.0)]))
    assert record.activities
    for name, n in (("kernels", 3), ("effects", 6), ("trials", 72), ("activation", 3), ("penalty", 3), ("about", 1)):
        assert spark.read.parquet(str(tmp_path / "out" / name)).count() == n
    with pytest.raises(Exception):
        workflow.run(spark, s, Library.of([]))
    lib = Library.of([(5.0, 16.0, 1.0, 1.0, 6.0, 0.0, 32.0)])
    kernels = spark.read.parquet(str(tmp_path / "out" / "kernels"))
    same = workflow.reliability({"a": kernels, "b": kernels}, lib).collect()
    assert len(same) == 3 and all(r["r"] == pytest.approx(1) and r["pairs"] == 1 for r in same)
    with pytest.raises(ValueError):
        workflow.reliability({"a": kernels}, lib)
    # trials have each feature's own kernel and the fraction that was tuned for it
    from ripplemark.operators import estimators as E
    from ripplemark.plans import design as X

    session, _ = workflow.load(spark, s)
    picks = {r["feature"]: r for r in spark.read.parquet(str(tmp_path / "out" / "penalty")).collect()}
    ns = workflow.nuisance(session)
    got = {(r["run"], r["feature"], r["trial"]): r["coef"] for r in spark.read.parquet(str(tmp_path / "out" / "trials")).collect()}
    rows = session.signal.toPandas()
    for f, pick in picks.items():
        x = X.event_responses(session.events[2], session.times[2], lib.parameters[pick["kernel"]])
        y = rows[(rows["run"] == 2) & (rows["feature"] == f)].sort_values("scan")[["y"]].to_numpy()
        want = E.TrialPath.of(x, ns[2], False).fractional(y, pick["penalty"])[0][:, 0]
        np.testing.assert_allclose([got[2, f, t] for t in range(8)], want, rtol=1e-8)
    monkeypatch.setattr(workflow.N, "pool_threshold", lambda stat: 0.5)  # three features make no mixture
    more = workflow.analyse(session, Settings(str(tmp_path), "1", "a", "t", modulators=s.modulators, penalty="none", denoise=True, skip=("glms", "summaries")), lib)
    assert more["denoising"].where("chosen").count() == 1 and more["trials"].count() == 72
    more = workflow.analyse(session, Settings(str(tmp_path), "1", "a", "t", modulators=s.modulators, penalty="ridge_cv", skip=("selection", "glms")), lib)
    assert more["penalty"].select("penalty").distinct().count() == 1 and more["trials"].where("coef is not null").count() == 72


def test_streaming_moments_equal_batch(spark, tmp_path):
    from ripplemark.streaming import moments as S

    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "ab"[m % 2], float(m), float(h + m)) for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, k string, x double, y double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.start(S.windowed_moments(stream, "t", "1 hour", "10 minutes", ["k"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r["window"]["start"], r["k"]): (r["n"], r["xy"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = S.moments(df.withColumn("window", F.window("t", "1 hour")), ["window", "k"]).collect()
    want = {(r["window"]["start"], r["k"]): (r["n"], r["xy"]) for r in batch}
    assert got and all(want[k] == pytest.approx(v) for k, v in got.items())
    far = S.effects(S.moments(df.select("k", (F.col("x") + 1e9).alias("x"), (3 * F.col("x") + 1e9).alias("y")), ["k"])).collect()
    assert all(r["effect"] == pytest.approx(3) for r in far)  # means far from 0 cancel nothing
    assert S.effects(S.moments(df, ["k"])).where("effect is not null").count() == 2

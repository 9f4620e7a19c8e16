"""A session's analysis: load, select kernels, fit, summarise, publish. Stages build DataFrames; only designs and summaries reach the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.operators import denoising as N
from ripplemark.operators import dense as B
from ripplemark.operators import diagnostics as D
from ripplemark.operators import estimators as E
from ripplemark.operators.nested import Problem, Tuned, coefficients, nested_evaluation, tune
from ripplemark.plans import design as X
from ripplemark.plans.kernels import Library, default_library
from ripplemark.plans.model import TaskModel, contrast_vector
from ripplemark.plans.provenance import Record, Source, analysis_fingerprint, data_fingerprint, operation
from ripplemark.plans.settings import Plan, Settings, plan
from ripplemark.sources import files
from ripplemark.sources.publish import json_artifact, publish_tables
from ripplemark.sources.tables import feature_blocks, packed


@dataclass
class Session:
    """Signals (run, scan, t, feature, y) stay in Spark; events, times and confounds of a run are small."""

    signal: DataFrame
    events: Mapping[int, pd.DataFrame]
    times: Mapping[int, np.ndarray]
    confounds: Mapping[int, pd.DataFrame | None]

    @property
    def runs(self) -> list[int]:
        return sorted(self.events)


def load(spark: SparkSession, settings: Settings) -> tuple[Session, Record]:
    """Reads a session. Response times that are not above 0 count as missing."""
    found = files.discover(files.list_names(spark, settings.input_dir), settings.subject, settings.session, settings.task)
    signal, events, times, confounds = None, {}, {}, {}
    for f in found:
        rows = spark.read.parquet(f.signal).select(F.lit(f.run).alias("run"), "scan", "t", "feature", "y")
        signal = rows if signal is None else signal.unionByName(rows)
        e = files.read_events(spark, f.events).orderBy("event_index").toPandas()  # a run's events: hundreds
        e["response_time"] = e["response_time"].where(e["response_time"] > 0)
        events[f.run] = e
        one = rows.select("feature").first()  # the scans of one feature are those of the run
        times[f.run] = np.array([r["t"] for r in rows.where(F.col("feature") == F.lit(one["feature"] if one else None)).select("scan", "t").distinct().orderBy("scan").collect()])  # hundreds
        confounds[f.run] = files.read_table(spark, f.confounds).toPandas().apply(pd.to_numeric) if f.confounds else None
    assert signal is not None
    sources = tuple(Source(role, uri=u) for f in found for role, u in (("signal", f.signal), ("events", f.events)))
    return Session(signal, events, times, confounds), Record(sources, data_fingerprint=data_fingerprint(sources))


def nuisance(session: Session) -> dict[int, np.ndarray]:
    return {r: X.compile_nuisance(session.times[r], session.confounds[r]).matrix for r in session.runs}


def candidate_designs(session: Session, library: Library, model: TaskModel) -> dict[int, E.CandidateRun]:
    """Task columns of every candidate kernel, indicators of missing values apart."""
    out = {}
    for r, n in nuisance(session).items():
        blocks, extra = [], []
        for i in range(len(library)):
            columns = X.task_columns(session.events[r], session.times[r], model, lambda dt, over, i=i: library.kernel(i, dt / over))
            profiled = [c for c in model.profiled if c in columns]
            blocks.append(columns.drop(columns=profiled).to_numpy(float))
            extra.append(columns[profiled].to_numpy(float))
        out[r] = E.candidate_run(n, blocks, extra)
    return out


def denoised(session: Session, signal: DataFrame, settings: Settings) -> tuple[Session, N.Denoising]:
    """The session with noise components among its confounds, found with one response shared by all events."""
    ns = nuisance(session)
    task = {r: X.event_responses(session.events[r], session.times[r]).sum(axis=1, keepdims=True) for r in session.runs}
    found = N.select_components(signal, task, ns, noise=settings.noise, block=settings.block_size)
    confounds = {}
    for r in session.runs:
        own = pd.DataFrame(found.components[r], columns=found.names())
        old = session.confounds[r]
        confounds[r] = own if old is None else pd.concat([old.reset_index(drop=True), own], axis=1)
    return replace(session, confounds=confounds), found


def trial_problem(session: Session, settings: Settings, model: TaskModel, library: Library | None) -> Problem:
    """What tuning needs: trial designs of the library's kernels (or the canonical one), predictors, the grid."""
    chosen = library or Library.of([])
    trials = X.LazyTrials(session.events, session.times, chosen.kernel, len(chosen))
    kind, grid = ("ridge", settings.alphas) if settings.penalty == "ridge_cv" else ("fraction", settings.fractions)
    predictors = {r: np.column_stack([v for m in settings.modulators for v in X.amplitudes(session.events[r], m).values()]) for r in session.runs} if settings.modulators else {}
    candidates = candidate_designs(session, library, model) if library else None
    return Problem(trials, nuisance(session), predictors, grid, kind, candidates, settings.encoding, settings.percentile / 100, settings.block_size)


def analyse(session: Session, settings: Settings, library: Library | None = None) -> dict[str, DataFrame]:
    """Result tables of the stages that run. Trials have the kernels of the selection and the penalty that was tuned with them."""
    stages = settings.stages()
    model = TaskModel(settings.modulators)
    rows = session.signal.select("run", "scan", "feature", "y")
    if settings.max_features is not None:  # a caller's limit
        rows = rows.join(feature_blocks(rows, settings.block_size, settings.max_features).select("feature"), "feature", "left_semi")
    signal = packed(rows)
    out: dict[str, DataFrame] = {}
    if settings.denoise:
        session, found = denoised(session, signal, settings)
        out["denoising"] = found.scores.withColumn("chosen", F.col("count") == found.count)
    ns = nuisance(session)
    select = "selection" in stages
    library = (library or default_library(settings.kernel_samples, settings.kernel_seed)) if select else None
    if library:
        out["kernels"] = B.select_kernels(signal, candidate_designs(session, library, model), settings.block_size)
    if "glms" in stages:
        designs = {r: X.compile_design(session.events[r], session.times[r], session.confounds[r], task_model=model) for r in session.runs}
        contrasts = {n: {r: contrast_vector({n: 1.0}, d.names) for r, d in designs.items()} for n in model.regressors}
        out["effects"] = B.fit_glm(signal, {r: d.matrix for r, d in designs.items()}, contrasts, settings.noise, settings.block_size)
        out["task_r2"] = B.task_delta_r2(signal, {r: d.matrix for r, d in designs.items()}, ns, settings.block_size)
    if "trials" in stages:
        problem = trial_problem(session, settings, model, library)
        if settings.penalty != "none" and settings.modulators:
            tuned = tune(signal, problem, session.runs)
            out["penalty"] = tuned.picks
            if len(session.runs) >= 6:  # three runs on either side
                out["outer"] = nested_evaluation(signal, problem)[0]
        else:
            kernels = out["kernels"].select("feature", "kernel") if library else signal.select("feature").distinct().withColumn("kernel", F.lit(0))
            tuned = Tuned(kernels, 0.0, kernels)
        out["trials"] = coefficients(signal, problem, tuned)
    if "summaries" in stages:
        out["activation"] = D.one_sample_t(out["trials"], "feature", "coef")
    return out


def reliability(picks: Mapping[str, DataFrame], library: Library) -> DataFrame:
    """feature, pairs, r, canonical_r, delta: how alike the kernels are that sessions choose. picks: session to its table of kernels."""
    rows = None
    for name, table in sorted(picks.items()):
        own = table.select(F.lit(name).alias("session"), "feature", "kernel")
        rows = own if rows is None else rows.unionByName(own)
    if rows is None or len(picks) < 2:
        raise ValueError("reliability needs two sessions")
    return D.session_reliability(rows, D.curve_correlations(library.frame(rows.sparkSession)), "session", "feature", "kernel")


def run_sessions(spark: SparkSession, wanted: Sequence[Settings], library: Library | None = None) -> list[Record]:
    """Sessions one after the other; several that publish to one folder get a folder each in it, and their reliability beside them."""
    several = len(wanted) > 1
    each = [replace(s, output_dir=f"{s.output_dir}/ses-{s.session}") if several and s.output_dir else s for s in wanted]
    records = [run(spark, s, library) for s in each]
    if several and all(s.output_dir and "selection" in s.stages() for s in wanted) and len({s.output_dir for s in wanted}) == 1:
        chosen = library or default_library(wanted[0].kernel_samples, wanted[0].kernel_seed)
        picks = {s.session: spark.read.parquet(f"{s.output_dir}/kernels") for s in each}
        publish_tables(spark, f"{wanted[0].output_dir}/reliability", {"sessions": reliability(picks, chosen)}, overwrite=wanted[0].overwrite)
    return records


def dry_run(spark: SparkSession, settings: Settings) -> Plan:
    names = files.list_names(spark, settings.input_dir)
    return plan(settings, names)


def run(spark: SparkSession, settings: Settings, library: Library | None = None) -> Record:
    """The whole session; publishes its tables together, with settings and provenance beside them."""
    problems = dry_run(spark, settings).problems
    if problems:
        raise ValueError("; ".join(problems))
    with operation("session") as op:
        session, record = load(spark, settings)
        tables = analyse(session, settings, library)
        record = record.extend({"name": "session", "command": settings.command()}, op.events, analysis=analysis_fingerprint(record.data_fingerprint, settings.command()))
        if settings.output_dir:
            about = spark.createDataFrame([(json_artifact("settings.json", settings.command()).data.decode(), record.to_json(), report(settings, session, list(tables)))], "settings string, provenance string, report string")
            publish_tables(spark, settings.output_dir, tables | {"about": about.coalesce(1)}, overwrite=settings.overwrite)
    return record


def report(settings: Settings, session: Session, tables: list[str]) -> str:
    """A short HTML page on what was run."""
    import html

    rows = "".join(f"<tr><td>{r}</td><td>{len(session.times[r])}</td><td>{len(session.events[r])}</td></tr>" for r in session.runs)
    command = html.escape(" ".join(settings.command()))
    return f"<html><body><h1>{html.escape(settings.subject)} {html.escape(settings.session)}</h1><pre>{command}</pre><table><tr><th>run</th><th>scans</th><th>events</th></tr>{rows}</table><p>{html.escape(', '.join(tables))}</p></body></html>"

"""Delimited event, confound and side-car files, and the discovery of a session's runs.

Paths are read by Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = re.compile(r"[A-Za-z0-9]+")
#: The six rigid-body parameters, whose differences and squares are confounds too.
MOTION = ("trans_x", "trans_y", "trans_z", "rot_x", "rot_y", "rot_z")


def entity(value: str, name: str) -> str:
    """A label of letters and digits, without its prefix."""
    text = value.removeprefix(f"{name}-")
    if not ENTITY.fullmatch(text):
        raise ValueError(f"{name} {value!r} is not of letters and digits")
    return text


def relative_path(text: str) -> str:
    """A relative path with / between plain parts."""
    parts = text.split("/")
    if not text or text.startswith("/") or any(p in ("", ".", "..") for p in parts) or re.search(r"[\\\x00-\x1f]", text):
        raise ValueError(f"{text!r} is no plain relative path")
    return text


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A tab-separated file with names in its first line; n/a is missing. Without a schema every column is text, so nothing is read twice."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "n/a")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_sidecar(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON object in a file of its own."""
    return spark.read.schema(schema).json(path, multiLine=True)


EVENTS = "onset double, duration double, trial_type string, response_time double"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """event_index by order of onset, and the columns of the schema that the file has."""
    rows = read_table(spark, path)
    wanted = T.StructType.fromDDL(schema)
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    w = Window.orderBy("onset", "duration")
    return rows.select(*columns).withColumn("event_index", F.row_number().over(w) - 1)


@dataclass(frozen=True)
class RunFiles:
    """What belongs to a run, by its number."""

    run: int
    events: str
    signal: str
    confounds: str | None = None


_NAME = re.compile(r"sub-(?P<sub>[A-Za-z0-9]+)_(?:ses-(?P<ses>[A-Za-z0-9]+)_)?task-(?P<task>[A-Za-z0-9]+)_(?:run-(?P<run>\d+)_)?(?P<rest>.*)")


def discover(names: Sequence[str], subject: str, session: str | None, task: str, signal_suffix: str = "signal.parquet") -> list[RunFiles]:
    """Runs of a session among file names: every events file needs one signal file, and no signal file is left over."""
    events, signals, confounds = {}, {}, {}
    for name in names:
        m = _NAME.fullmatch(name.rsplit("/", 1)[-1])
        if not m or m["sub"] != entity(subject, "sub") or m["task"] != entity(task, "task") or (session is not None and m["ses"] != entity(session, "ses")):
            continue
        run = int(m["run"] or 1)
        for suffix, found in (("events.tsv", events), (signal_suffix, signals), ("confounds.tsv", confounds)):
            if m["rest"].endswith(suffix):
                if run in found:
                    raise ValueError(f"run {run} has two files that end in {suffix}")
                found[run] = name
    if not events:
        raise ValueError("the session has no runs")
    if set(events) != set(signals):
        raise ValueError(f"runs without both files: {sorted(set(events) ^ set(signals))}")
    return [RunFiles(r, events[r], signals[r], confounds.get(r)) for r in sorted(events)]


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names below a folder, by Spark's file systems."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        out.append(files.next().getPath().toString())
    return sorted(out)


def frame_times(scans: int, step: float, offset: float = 0.0, stated: float | None = None) -> np.ndarray:
    """Times of scans; a stated step must be the file's own to a thousandth."""
    if not step > 0 or scans < 1 or (stated is not None and abs(stated - step) > 1e-3 * step):
        raise ValueError("the step between scans is positive and the same in all files")
    return offset + step * np.arange(scans)


def confound_names(columns: Sequence[str], metadata: Mapping[str, Mapping], components: int = 6) -> list[str]:
    """Motion with differences and squares, the leading retained combined components by explained variance, cosines, and spikes."""
    out = []
    for base in MOTION:
        for suffix in ("", "_derivative1", "_power2", "_derivative1_power2"):
            if base + suffix not in columns:
                raise ValueError(f"confound {base + suffix} is absent")
            out.append(base + suffix)
    ranked = sorted(
        (c for c in columns if c.startswith("a_comp_cor_") and metadata.get(c, {}).get("Retained", True) and metadata.get(c, {}).get("Mask", "combined") == "combined"),
        key=lambda c: (-float(metadata.get(c, {}).get("VarianceExplained", 0.0)), c),
    )
    if len(ranked) < components:
        raise ValueError(f"fewer than {components} components are retained")
    out += ranked[:components]
    return out + [c for c in columns if c.startswith(("cosine", "motion_outlier", "non_steady_state_outlier"))]


def first_difference_filled(df: DataFrame, columns: Sequence[str], order: str = "scan") -> DataFrame:
    """Missing values of differences become 0 at the first scan, and only there."""
    return df.select(*(F.when(F.col(order) == 0, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns))

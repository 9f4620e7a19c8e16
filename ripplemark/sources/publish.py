"""Publishing a set of files together: all of them or none.

Small artifacts (JSON, text, tables that fit on the driver) go through ``publish``; large tables are written by Spark to a staging folder
and moved by ``publish_tables``, which uses the store's own rename.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ripplemark.sources.files import relative_path

CONTROL = ".publishing"


@dataclass(frozen=True)
class Artifact:
    path: str
    data: bytes

    def __post_init__(self):
        relative_path(self.path)


def json_artifact(path: str, value) -> Artifact:
    return Artifact(path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n").encode())


def table_artifact(path: str, columns: Iterable[str], rows: Iterable[Iterable]) -> Artifact:
    """Tab-separated, missing values as n/a."""

    def text(v) -> str:
        return "n/a" if v is None or v != v else repr(v) if isinstance(v, float) else str(v)

    lines = ["\t".join(columns), *("\t".join(map(text, r)) for r in rows)]
    return Artifact(path, ("\n".join(lines) + "\n").encode())


class _Lock:
    def __init__(self, folder: Path, wait: float):
        self.path, self.wait = folder / "lock", wait

    def __enter__(self):
        end = time.monotonic() + self.wait
        while True:
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL))
                return self
            except FileExistsError:
                if time.monotonic() >= end:
                    raise TimeoutError(f"{self.path} is held by another writer") from None
                time.sleep(0.05)

    def __exit__(self, *_):
        self.path.unlink(missing_ok=True)


def publish(destination: str | Path, artifacts: Iterable[Artifact], *, overwrite: bool = False, wait: float = 30.0, manifest: str | None = None, keep: Iterable[str] = ()) -> None:
    """Write all artifacts, or leave the destination as it was. With a manifest, files that the last one names and this set lacks are removed, but for those to keep."""
    root, items = Path(destination), {a.path: a.data for a in artifacts}
    if manifest is not None:
        items[relative_path(manifest)] = json_artifact(manifest, sorted(items)).data
    root.mkdir(parents=True, exist_ok=True)
    control = root / CONTROL
    control.mkdir(exist_ok=True)
    with _Lock(control, wait):
        stale: set[str] = set()
        if manifest is not None and (root / manifest).exists():
            stale = {relative_path(p) for p in json.loads((root / manifest).read_text())} - set(items) - set(keep)
        present = [p for p in items if (root / p).exists()]
        if present and not overwrite:
            raise FileExistsError(f"{present[0]} exists")
        work = control / uuid.uuid4().hex
        moved: list[tuple[Path, Path]] = []
        placed: list[Path] = []
        try:
            for p, data in items.items():
                target = work / "new" / p
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(data)
            for p in sorted({*present, *(s for s in stale if (root / s).exists())}):
                backup = work / "old" / p
                backup.parent.mkdir(parents=True, exist_ok=True)
                os.replace(root / p, backup)
                moved.append((backup, root / p))
            for p in items:
                (root / p).parent.mkdir(parents=True, exist_ok=True)
                os.replace(work / "new" / p, root / p)
                placed.append(root / p)
        except BaseException:
            for p in placed:
                p.unlink(missing_ok=True)
            for backup, p in moved:
                os.replace(backup, p)
            raise
        finally:
            shutil.rmtree(work, ignore_errors=True)


def publish_tables(spark: SparkSession, destination: str, tables: Mapping[str, DataFrame], *, overwrite: bool = False) -> None:
    """Write tables as Parquet to a staging folder, then rename each into place; on failure those already there are put back."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(p: str):
        return jvm.org.apache.hadoop.fs.Path(p)

    fs = path(destination).getFileSystem(conf)
    staging = f"{destination.rstrip('/')}/{CONTROL}/{uuid.uuid4().hex}"
    for name in tables:
        relative_path(name)
        if not overwrite and fs.exists(path(f"{destination}/{name}")):
            raise FileExistsError(f"{name} exists")
    old, new = [], []
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staging}/new/{name}")
        for name in tables:
            target = path(f"{destination}/{name}")
            fs.mkdirs(target.getParent())
            if fs.exists(target):
                fs.mkdirs(path(f"{staging}/old/{name}").getParent())
                if not fs.rename(target, path(f"{staging}/old/{name}")):
                    raise OSError(f"{name} cannot be set aside")
                old.append(name)
            if not fs.rename(path(f"{staging}/new/{name}"), target):
                raise OSError(f"{name} cannot be moved into place")
            new.append(name)
    except BaseException:
        for name in new:
            fs.delete(path(f"{destination}/{name}"), True)
        for name in old:
            fs.rename(path(f"{staging}/old/{name}"), path(f"{destination}/{name}"))
        raise
    finally:
        fs.delete(path(staging), True)

"""Where results come from: sources, activities, fingerprints, and what happened."""

from __future__ import annotations

import contextlib
import datetime
import json
import logging
import platform
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from ripplemark.functions.fingerprints import canonical_json, freeze, json_digest, thaw

LOG = logging.getLogger("ripplemark")
#: Events that a record keeps.
HISTORY = 8


@dataclass(frozen=True)
class Source:
    """A file or table: role, place, size and time of change, digest."""

    role: str
    uri: str | None = None
    byte_size: int | None = None
    modified_at: str | None = None
    sha256: str | None = None
    annotations: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not self.role:
            raise ValueError("a source has a role")
        if self.byte_size is not None and (isinstance(self.byte_size, bool) or self.byte_size < 0):
            raise ValueError("a size is not negative")
        if self.modified_at is not None and datetime.datetime.fromisoformat(self.modified_at).utcoffset() != datetime.timedelta(0):
            raise ValueError("a time of change is in UTC")
        object.__setattr__(self, "annotations", freeze(dict(self.annotations)))

    @property
    def complete(self) -> bool:
        return None not in (self.uri, self.byte_size, self.modified_at)

    def as_dict(self) -> dict:
        return {k: thaw(v) if k == "annotations" else v for k, v in self.__dict__.items() if v is not None and v != {}}


def data_fingerprint(sources: Sequence[Source]) -> str | None:
    """Digest of place, size and time of all sources; None if one lacks any."""
    if not sources or not all(s.complete for s in sources):
        return None
    return json_digest([[s.role, s.uri, s.byte_size, s.modified_at] for s in sources])


def analysis_fingerprint(data: str | None, model: Any) -> str | None:
    return None if data is None else json_digest({"data": data, "model": model})


@dataclass(frozen=True)
class Record:
    """Provenance of a result."""

    sources: tuple[Source, ...] = ()
    activities: tuple[Mapping, ...] = ()
    events: tuple[Mapping, ...] = ()
    warnings: tuple[str, ...] = ()
    data_fingerprint: str | None = None
    analysis_fingerprint: str | None = None

    def extend(self, activity: Mapping, events: Sequence[Mapping] = (), warnings: Sequence[str] = (), analysis: str | None = None) -> Record:
        return replace(
            self, activities=(*self.activities, freeze(dict(activity))), events=(*self.events, *events)[-HISTORY:],
            warnings=(*self.warnings, *warnings), analysis_fingerprint=analysis or self.analysis_fingerprint,
        )

    def to_json(self) -> str:
        return canonical_json({
            "sources": [s.as_dict() for s in self.sources], "activities": [thaw(a) for a in self.activities], "events": [thaw(e) for e in self.events],
            "warnings": list(self.warnings), "data_fingerprint": self.data_fingerprint, "analysis_fingerprint": self.analysis_fingerprint,
        })


def check_parent(expected: str | None, found: str | None) -> None:
    """Raises if a result was made from another analysis."""
    if expected is None or expected != found:
        raise ValueError("the parent result is of another analysis, or cannot be told")


def environment() -> dict[str, str]:
    """Versions of what computes."""
    import numpy
    import pyspark

    return {"python": platform.python_version(), "numpy": numpy.__version__, "pyspark": pyspark.__version__}


def error_code(error: BaseException) -> str:
    kinds = ((TimeoutError, "timeout"), (FileExistsError, "exists"), (FileNotFoundError, "absent"), (OSError, "storage"), (ArithmeticError, "numerical"), (ValueError, "invalid"), (TypeError, "invalid"))
    return next((c for k, c in kinds if isinstance(error, k)), "failed")


class Operation:
    """Events of a running operation."""

    def __init__(self, name: str):
        self.name, self.id, self.events = name, uuid.uuid4().hex, []

    def emit(self, event: str, **more: Any) -> None:
        item = {"operation": self.name, "id": self.id, "event": event, **more}
        self.events = [*self.events, freeze(item)][-HISTORY:]
        LOG.log(logging.ERROR if event == "failed" else logging.INFO, json.dumps(item, sort_keys=True))


@contextlib.contextmanager
def operation(name: str) -> Iterator[Operation]:
    """Logs start, and completion or failure with an error code."""
    op = Operation(name)
    op.emit("started")
    try:
        yield op
    except BaseException as error:
        op.emit("failed", code=error_code(error))
        raise
    op.emit("completed")


def graph(record: Record) -> dict:
    """The record as entities, activities and their links."""
    entities = {f"source{i}": s.as_dict() for i, s in enumerate(record.sources)}
    acts = {f"activity{i}": thaw(a) for i, a in enumerate(record.activities)}
    return {"entity": entities, "activity": acts, "used": [{"activity": a, "entity": e} for a in acts for e in entities], "environment": environment()}



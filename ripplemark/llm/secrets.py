"""Secrets in texts, found by one combined automaton (see scanner).

Null texts are empty and hold no spans. Every input row gives one output row, null or repeated ids
and texts included; an empty table gives an empty result. Texts of any length are scanned whole, in
one pass over their bytes without a shuffle. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ripplemark.llm.common import chunks, id_text, map_arrow
from ripplemark.llm.scanner import Scanner

#: The rules asked for, and formats of widely used credentials that the method adds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+"""
BASE = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{14,}"), ("hex", "[0-9a-f]{16,}"))
MORE = (("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("github", "gh[pousr]_[A-Za-z0-9]+"), ("slack", "xox[abprs]-[A-Za-z0-9-]+"), ("google", "AIza[A-Za-z0-9_-]+"))
#: The value of an assignment, and a whole match of other kinds, have at least so many characters; shorter ones are dropped.
LEAST_VALUE = 12
LEAST = {"github": 40, "slack": 15, "google": 39}
_HEAD = re.compile(r"""[A-Za-z_]+["']? *[:=] *["']?""")


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(BASE + MORE)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind in the order of the rules."""
    out = []
    for kind, a, b in scanner().scan(text):
        if kind == "assign" and b - _HEAD.match(text, a, b).end() < LEAST_VALUE:
            continue
        if b - a >= LEAST.get(kind, 0):
            out.append((kind, a, b))
    return out


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by a mask."""
    out, at = [], 0
    for _, a, b in find_secrets(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>, redacted: the secrets of every text, and the text without them."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part, texts in chunks(batches, "text"):
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find_secrets(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind), pa.array([redact(t) for t in texts], pa.string())], ["doc_id", "spans", "redacted"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, redacted string")


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every text."""

    def run(batches):
        base = [k for k, _ in BASE]
        for part, texts in chunks(batches, "text"):
            found = [find_secrets(t) for t in texts]
            written = [[f"{k}:{a}:{b}" for k, a, b in spans] for spans in found]
            own = [",".join(w for w, (k, _, _) in zip(ws, spans, strict=True) if k in base) for ws, spans in zip(written, found, strict=True)]
            columns = [part.column("doc_id")]
            columns += [pa.array([sum(k == kind for k, _, _ in spans) for spans in found], pa.int64()) for kind in base]
            columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own], pa.string()), pa.array([",".join(w) for w in written], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _duck_spans(kind: str, order: int, expression: str, test: str = "true") -> str:
    """Spans of one kind in DuckDB SQL: the texts between matches give their places."""
    quoted = expression.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS o, m AS match,
           list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS a
    FROM (SELECT doc_id, found, parts, unnest(found) AS m, generate_subscripts(found, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS found, string_split_regex(t, '{quoted}') AS parts FROM texts))
    WHERE {test}"""


def oracle_sql() -> str:
    """The same result in DuckDB SQL."""
    head = r"""^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?"""
    spans = [
        _duck_spans("assign", 0, ASSIGN, f"length(regexp_replace(m, '{head}', '')) >= {LEAST_VALUE}"),
        _duck_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18"),
        _duck_spans("hex", 2, "[0-9a-f]+", "length(m) >= 16"),
        *(_duck_spans(kind, 3 + i, x, f"length(m) >= {LEAST.get(kind, 0)}") for i, (kind, x) in enumerate(MORE)),
    ]
    own = "(kind IN ('assign', 'access', 'hex'))"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(spans)}),
    written AS (SELECT *, kind || ':' || a::BIGINT || ':' || (a + length(match))::BIGINT AS w FROM spans),
    merged AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(w, ',' ORDER BY a, o) FILTER {own.replace("(kind", "(WHERE kind")} AS own, string_agg(w, ',' ORDER BY a, o) AS spans
      FROM written GROUP BY doc_id)
    SELECT texts.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN merged USING (doc_id)"""

"""Personal data in texts: base patterns, and boosted trees that choose among overlapping candidates.

All work on rows is DataFrame functions: patterns, split places and higher-order functions over arrays in a row, so
nothing is shuffled and no Python runs on the executors.

Base spans are the matches of four patterns that pass their tests. Further generators propose stricter or
freer forms that may overlap them and each other (a card next to other digits or with other separators, a phone number without its plus,
addresses with "(at)" or "[.]"). Features of a candidate are its form (digits, separators, test passed) and context (characters
beside it, words of credentials before it).

Labels come from hiding what is known: every text of every document is taken as it is and once more with its base
spans disguised. A candidate is positive if its value (undisguised) is that of a base span of the document, and negative if not; whether the base
patterns find it is neither a feature nor the label, so candidates that they miss are judged by the same measure. Counts by
feature values are what trees learn from; half of the documents calibrate a threshold for each kind to a
precision of ``PRECISION`` among its candidates, and a kind that never reaches it adds nothing. Candidates from the threshold on that
overlap no base span and no candidate with a higher score (ties: the first kind, place and end) are added.

A null text is empty and has no spans. Every input row gives one output row, null and repeated ids included;
an empty table gives an empty result. Texts of any length are searched whole: patterns are possessive, so they neither
recurse nor backtrack over long runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.boosting import Boosted, boost, threshold
from ripplemark.llm.common import id_text

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The patterns asked for, written so that a match starts at the start of a run or where the last one
#: ended, and takes whole runs. \x20 is a space.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"(?:\[\.\]|\(\.\)|\.)"
_GAP = r"[\x20._/-]?"
#: Generators of further candidates.
MORE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?+(?:\(at\)|\[at\]|@)\x20?+{_LABEL}++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?{_LABEL}++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+{_DOT}[0-9]{{1,3}}+{_DOT}[0-9]{{1,3}}+{_DOT}[0-9]{{1,3}}+(?![0-9])",
    "card": rf"(?<![0-9])[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}(?:[0-9]{{1,3}})?+(?![0-9])",
    "phone": r"(?<![0-9])\+?+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: What hides a base span of a kind: a pattern and what stands for its matches.
DISGUISES = {
    "email": (rf"({_LOCAL}++)@({_LABEL}++\.)", "$1 (at) $2"),
    "ip": (r"(?<![0-9.])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)", "$1[.]$2[.]$3[.]$4"),
    "card": (r"(?<![0-9])([0-9]{4})[\x20-]?([0-9]{4})[\x20-]?([0-9]{4})[\x20-]?([0-9]{4})", "$1.$2.$3.$4"),
    "phone": (r"\+([0-9])", "$1"),
}
FEATURES = ("kind", "digits", "marks", "passed", "before", "after", "secret")


def _matches(text: str, pattern: str, kind: str) -> Column:
    """Matches of a pattern; an empty array where a needed character is absent."""
    needed = F.col("has_digit")
    if kind == "email":
        needed = F.contains(text, F.lit("@"))
        if pattern == MORE["email"]:
            needed = needed | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    elif pattern == BASE["phone"]:
        needed = F.contains(text, F.lit("+"))
    return F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _places(found: str, parts: str) -> Column:
    """Matches with their places: a, b (code points, b exclusive), m, and the texts before (15) and after (1)."""
    return F.expr(f"""
        aggregate(
          zip_with({found}, sequence(1, greatest(1, size({found}))), (m, i) -> struct(m AS m, {parts}[i - 1] AS pre, {parts}[i] AS post)),
          struct(0 AS pos, cast(array() AS array<struct<a: int, b: int, m: string, pre: string, post: string>>) AS out),
          (s, x) -> struct(
            s.pos + length(x.pre) + coalesce(length(x.m), 0) AS pos,
            concat(s.out, array(struct(s.pos + length(x.pre) AS a, s.pos + length(x.pre) + length(x.m) AS b, x.m AS m, right(x.pre, 15) AS pre, left(x.post, 1) AS post))) AS out),
          s -> s.out)""")


_DIGITS = "regexp_replace({x}.m, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"cast(substr({d}, i, 1) AS int)"
    doubled = f"CASE WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN (length({d}) - i) % 2 = 1 THEN {doubled} ELSE {digit} END) % 10 = 0"


def _value(kind: str, x: str) -> str:
    """A match without its disguise."""
    if kind == "email":
        return f"regexp_replace(regexp_replace(lower({x}.m), '\\\\x20?(?:[(]at[)]|[\\\\[]at[]])\\\\x20?', '@'), '\\\\x20?(?:[(]dot[)]|[\\\\[]dot[]])\\\\x20?', '.')"
    return f"regexp_replace({x}.m, '[()\\\\[\\\\]]', '')" if kind == "ip" else _DIGITS.format(x=x)


def _passes(kind: str, x: str) -> str:
    """The test of a kind."""
    d = _DIGITS.format(x=x)
    return {
        "email": "true",
        "ip": f"forall(split({_value('ip', x)}, '[.]'), y -> coalesce(try_cast(y AS int) <= 255, false))",
        "card": f"(length({d}) BETWEEN 16 AND 19 AND {_luhn(d)})",
        "phone": f"length({d}) BETWEEN 8 AND 15",
    }[kind]


def _char_class(c: str) -> str:
    """0: a space or nothing; 1: a letter; 2: a digit; 3: other."""
    return f"CASE WHEN {c} = '' OR {c} IS NULL OR {c} rlike '[\\\\x20\\\\x09-\\\\x0D]' THEN 0 WHEN {c} rlike '[0-9]' THEN 2 WHEN {c} rlike '\\\\p{{L}}' THEN 1 ELSE 3 END"


def _with_base(df: DataFrame) -> DataFrame:
    """doc_id, t, has_digit, and base_<kind>: arrays of the base spans (a, b, m, pre, post)."""
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", F.col("t").rlike("[0-9]").alias("has_digit"))
    return _located(rows, BASE, "base", tested=True)


def _located(rows: DataFrame, patterns: dict[str, str], name: str, tested: bool) -> DataFrame:
    """Adds <name>_<kind> for each pattern."""
    kept = rows.columns
    rows = rows.select("*", *(_matches("t", p, k).alias(f"f_{k}") for k, p in patterns.items()))
    none = F.array().cast("array<string>")
    rows = rows.select("*", *(F.when(F.size(f"f_{k}") > 0, F.split("t", p, -1)).otherwise(none).alias(f"p_{k}") for k, p in patterns.items()))
    empty = "cast(array() AS array<struct<a: int, b: int, m: string, pre: string, post: string>>)"
    rows = rows.select(*kept, *(F.when(F.size(f"f_{k}") > 0, _places(f"f_{k}", f"p_{k}")).otherwise(F.expr(empty)).alias(f"{name}_{k}") for k in patterns))
    if not tested:
        return rows
    return rows.select(*kept, *(F.expr(f"filter({name}_{k}, x -> {_passes(k, 'x')})").alias(f"{name}_{k}") for k in patterns))


def _candidates(rows: DataFrame, label: str) -> DataFrame:
    """Adds more: all further candidates, with features and a label (of x, a candidate of kind {i}, {k})."""
    rows = _located(rows, MORE, "more", tested=False)
    each = []
    for i, k in enumerate(KINDS):
        d = _DIGITS.format(x="x")
        each.append(f"""transform(more_{k}, x -> struct(
            {i} AS kind, x.a AS a, x.b AS b,
            least(length({d}), 20) AS digits,
            least(length(regexp_replace(x.m, '[A-Za-z0-9]', '')), 8) AS marks,
            CASE WHEN {_passes(k, "x")} THEN 1 ELSE 0 END AS passed,
            {_char_class("right(x.pre, 1)")} AS before, {_char_class("x.post")} AS after,
            CASE WHEN lower(x.pre) rlike '(?:pass|token|secret|key)[^a-z]{{0,8}}' THEN 1 ELSE 0 END AS secret,
            CASE WHEN {label.format(k=k, value=_value(k, "x"))} THEN 1 ELSE 0 END AS hit))""")
    kept = [c for c in rows.columns if not c.startswith("more_")]
    return rows.select(*kept, F.expr(f"concat({', '.join(each)})").alias("more"))


def disguised(text: Column) -> Column:
    """A text in which the base patterns find what they found before no more."""
    for pattern, instead in DISGUISES.values():
        text = F.regexp_replace(text, pattern, instead)
    return text


Model = tuple[Boosted, tuple[float, ...]]


def fit(df: DataFrame) -> Model:
    """Trees, and a threshold for each kind, from all rows. df: doc_id, text."""
    known = _with_base(df).select("doc_id", "t", *(F.expr(f"transform(base_{k}, x -> {_value(k, 'x')})").alias(f"known_{k}") for k in KINDS))
    twice = known.select("doc_id", *(f"known_{k}" for k in KINDS), F.explode(F.array("t", disguised(F.col("t")))).alias("t"))
    twice = twice.withColumn("has_digit", F.col("t").rlike("[0-9]"))
    found = _candidates(twice, "array_contains(known_{k}, {value})").select((F.xxhash64("doc_id", F.lit("half")) % 2 == 0).alias("first"), F.explode("more").alias("c"))
    counted = found.groupBy("first", *(F.col(f"c.{f}").alias(f) for f in FEATURES), F.col("c.hit").alias("hit")).count()
    rows = counted.collect()  # at most 2 x 4 x 21 x 9 x 2 x 4 x 4 x 2 x 2 rows, by the ranges of the features
    halves: dict[bool, list] = {True: [], False: []}
    for r in sorted(rows, key=tuple):
        halves[r["first"]].append((tuple(r[f] for f in FEATURES), r["hit"], r["count"]))
    if not halves[True]:
        return Boosted(0.0, ()), (math.inf,) * len(KINDS)
    model = boost(halves[True])
    least = [threshold(model, [r for r in halves[False] if r[0][0] == i], PRECISION) for i in range(len(KINDS))]
    return model, tuple(max(x, 0.0) for x in least)


def spans(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, t, spans: structs of kind (a number), a, b and base, by kind, place and end. df: doc_id, text."""
    trees, least = model
    over = " OR ".join(f"exists(base_{k}, y -> y.a < x.b AND x.a < y.b)" for k in KINDS)
    base = ", ".join(f"transform(base_{k}, x -> struct({i} AS kind, x.a AS a, x.b AS b, true AS base))" for i, k in enumerate(KINDS))
    rows = _with_base(df)
    if min(least) == math.inf:
        return rows.select("doc_id", "t", F.expr(f"array_sort(concat({base}))").alias("spans"))
    rows = _candidates(rows, over.replace("{", "{{").replace("}", "}}"))
    score = trees.sql([f"x.{f}" for f in FEATURES])
    enough = " ".join(f"WHEN x.kind = {i} THEN s >= {v!r}D" for i, v in enumerate(least) if v < math.inf)
    scored = f"transform(filter(more, x -> x.hit = 0), x -> struct(x.kind AS kind, x.a AS a, x.b AS b, {score} AS s))"
    rows = rows.select("*", F.expr(f"filter({scored}, x -> CASE {enough.replace('s >=', 'x.s >=')} ELSE false END)").alias("good"))
    better = "y.a < x.b AND x.a < y.b AND (y.s > x.s OR y.s = x.s AND struct(y.kind, y.a, y.b) < struct(x.kind, x.a, x.b))"
    added = f"transform(filter(good, x -> NOT exists(good, y -> {better})), x -> struct(x.kind AS kind, x.a AS a, x.b AS b, false AS base))"
    return rows.select("doc_id", "t", F.expr(f"array_sort(concat({base}, {added}))").alias("spans"))


def redacted(df: DataFrame) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are joined under the first."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    return F.expr(f"""
        aggregate(
          array_sort(transform(spans, x -> struct(x.a AS a, x.b AS b, x.kind AS kind))),
          struct(0 AS pos, '' AS out),
          (s, x) -> struct(
            greatest(s.pos, x.b) AS pos,
            CASE WHEN x.a >= s.pos THEN concat(s.out, substr(t, s.pos + 1, x.a - s.pos), array({names})[x.kind]) ELSE s.out END AS out),
          s -> concat(s.out, substr(t, s.pos + 1)))""")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with its texts redacted; all columns stay, rows without personal data stay as they are (null too)."""
    model = fit(id_text(df, id_col, text_col))
    held = df.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    found = _keeping(held, model, id_col, text_col)
    return found.select(*(F.when(F.size("spans") > 0, F.col("clean")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def _keeping(held: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """row, spans, clean: the row itself rides along in place of its id."""
    rows = held.select(F.col("__row").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return spans(rows, model).select(F.col("doc_id").alias("row"), "spans", redacted(held).alias("clean"))


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>>, redacted text, for every row."""
    rows = id_text(df, id_col, text_col)
    names = ", ".join(f"'{k}'" for k in KINDS)
    out = spans(rows, fit(rows))
    written = F.expr(f"transform(spans, x -> struct(array({names})[x.kind] AS kind, cast(x.a AS long) AS start, cast(x.b AS long) AS end, x.base AS base))")
    return out.select("doc_id", written.alias("spans"), redacted(out).alias("redacted"))


def personal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    rows = id_text(df, id_col, text_col)
    names = ", ".join(f"'{k}'" for k in KINDS)
    written = f"transform({{}}, x -> concat(array({names})[x.kind], ':', x.a, ':', x.b))"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base AND x.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    own = F.array_join(F.expr(written.format("filter(spans, x -> x.base)")), ",")
    found = spans(rows, fit(rows)).select("doc_id", "spans")
    return found.select("doc_id", *counts, F.sha2(own.cast("binary"), 256).alias("base_sha256"), F.array_join(F.expr(written.format("spans")), ",").alias("spans"))

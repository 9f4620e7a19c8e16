from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.llm import boosting, jpeg, media, personal, queries, scanner, secrets
from tests.oracle import assert_same, connection

# -- secrets --


def brute_secrets(x):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 16]
    for i, (kind, rule) in enumerate(secrets.MORE, 3):
        out += [(m.start(), i, kind, m.end()) for m in re.finditer(rule, x) if len(m[0]) >= secrets.LEAST.get(kind, 0)]
    return [(k, a, b) for a, _, k, b in sorted(out)]


BITS = ["password", "token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "0123456789ab", "DEADBEEF0123", "é", "x.y/z+", "ghp_", "A" * 40, "-----BEGIN RSA PRIVATE KEY-----", "a1b2c3d4e5f60718", "xoxb-", "日", "AIza", "Q" * 20]


def test_scanner_equals_separate_searches():
    rng = random.Random(9)
    for _ in range(4000):
        x = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 14)))
        assert secrets.find_secrets(x) == brute_secrets(x), x


def test_rules_that_cannot_be_scanned_are_rejected():
    with pytest.raises(ValueError):
        scanner.Scanner([("x", "a(bc)?")])
    with pytest.raises(ValueError):
        scanner.Scanner([("x", "a*")])


def test_redacted_texts():
    assert secrets.redact("token = abcdefabcdefabcdef01 end") == "[SECRET] end"
    assert secrets.redact("nothing") == "nothing"


def table(spark):
    rows = [(1, "password=abcdefghijkl é token: 'zzzzzzzzzzzzzz'", "a"), (2, None, "a"), (3, "", "a"), (None, "AKIA" + "B" * 20, "a"), (4, "x" * 50_000 + " " + "ab12" * 5, "a"), (4, "dup", "a"), (4, "dup", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_secret_digests(spark):
    rows = secrets.secret_digests(table(spark)).collect()
    assert len(rows) == 7
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 4}
    assert (by[1]["n_assign"], by[1]["spans"]) == (2, "assign:0:21,assign:24:46")
    assert by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[None]["n_access"] == 1
    assert secrets.secret_digests(table(spark).where("false")).count() == 0
    assert secrets.secret_spans(table(spark)).where("doc_id = 1").first()["redacted"].startswith("[SECRET]")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, data):
    assert_same(queries.QUERIES[name](spark, data), connection(data), queries.ORACLES[name])


# -- personal data --

KINDS = personal.KINDS


def luhn(d):
    return sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_personal(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(2, m.start(), m.end())] if 16 <= len(d) <= 19 and luhn(d) else []
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PARTS = ["a@b.co", "x.y@z-1.com_", "@", ".", "q", " ", "1.2.3.4", "999.1.1.1", "4111111111111111", "4111 1111 1111 1111", "4111111111111112", "+1 (319) 555-5132", "+", "-", "12", "é", "a@b", "_d@e.f", "\n", "00000000255.1.1.1", "+4", "()"]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9))) for _ in range(1500)] + [" ".join(["7"] * 5000), "9" * 30000, "a" * 30000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = personal.personal_digests(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_personal(texts[r["doc_id"]] or "")
        written = [f"{KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert tuple(r[f"n_{k}"] for k in KINDS) == tuple(sum(w[0] == i for w in want) for i in range(4))
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r["spans"].split(",") if r["spans"] else [])


def test_added_spans_and_redaction(spark):
    rng = random.Random(8)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    texts = [f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now or pay {card()} soon" for _ in range(400)]
    merged = [f"see 10.0.0.7 {card()} there" for _ in range(5)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts + merged)], "doc_id long, text string, n_chars long, spans string")
    rows = {r["doc_id"]: r for r in personal.personal_spans(df).collect()}
    assert any(not s["base"] and s["kind"] == "card" for i in range(400, 405) for s in rows[i]["spans"])
    assert rows[0]["redacted"].startswith("call [PHONE] now or pay [CARD]")
    out = personal.redact(df.union(df.select("doc_id", df.text.substr(1, 0).alias("text"), "n_chars", "spans").limit(1)))
    assert out.columns == df.columns and out.count() == 406 and out.where("text like '%555-%'").count() == 0
    null = spark.createDataFrame([(1, None, 2, "s")], df.schema)
    assert personal.redact(null).first()["text"] is None
    assert personal.personal_digests(df.where("false")).count() == 0


def test_hidden_spans_are_added_and_judged_by_their_kind(spark):
    rng = random.Random(9)

    def card(valid=True):
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c) == valid)

    def split(d, mark):
        return mark.join(d[i : i + 4] for i in range(0, 16, 4))

    texts = [f"mail ann{i}@x{i}.example.com from 10.1.{i % 250}.7, pay {split(card(), ' ')} or not {split(card(False), ' ')}." for i in range(400)]
    hidden = [f"mail bob{i + 100} (at) y{i + 100}.example.com from 10.2.3[.]{i}, pay {split(card(), '.')} or not {split(card(False), '.')}." for i in range(20)]
    clean = [f"the item {rng.randint(1, 9)}{rng.randint(100, 999)} was on page {i} at (at) noon" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts + hidden + clean)), "doc_id long, text string")
    trees, least = personal.fit(df)
    assert len(least) == 4 and all(x < float("inf") for x in least[:3]) and least[3] == float("inf")
    rows = {r["doc_id"]: r["spans"] for r in personal.personal_spans(df).collect()}
    added = {d: {s["kind"] for s in spans if not s["base"]} for d, spans in rows.items()}
    assert all({"email", "card"} <= added[d] for d in range(400, 420)) and not any(added[d] for d in range(420, 620))
    for d in range(400, 420):  # the card that fails its test stays
        assert sum(s["kind"] == "card" for s in rows[d]) == 1
    for spans in rows.values():  # added spans overlap nothing
        for s in spans:
            assert s["base"] or not any(o is not s and o["start"] < s["end"] and s["start"] < o["end"] for o in spans)


def test_boosting_learns_and_writes_sql(spark):
    rows = [((a, b), int(a > 2 and b <= 1), 10) for a in range(6) for b in range(4)]
    model = boosting.boost(rows)
    assert all((model.raw(x) > 0) == bool(y) for x, y, _ in rows)
    df = spark.createDataFrame([x for x, _, _ in rows], "a int, b int").selectExpr("a", "b", f"{model.sql(['a', 'b'])} AS s")
    assert all(abs(r["s"] - model.raw((r["a"], r["b"]))) < 1e-9 for r in df.collect())
    assert boosting.threshold(model, rows, 0.99) > 0 and boosting.boost([((0,), 1, 5)]).trees == ()
    assert boosting.threshold(model, [((0, 0), 0, 5)], 0.9) == float("inf")


# -- media --


@pytest.mark.parametrize("blocks", [1, 2, 3, 7, 33])
def test_jpeg_round_trip_by_both_readers(blocks):
    payload = np.random.default_rng(blocks).integers(0, 256, 64 * blocks, np.uint8).tobytes()
    data = jpeg.write_payload(payload)
    fast, slow = jpeg.read(data), jpeg.read(data, fixed=False)
    assert jpeg.payload_of(fast) == payload == jpeg.payload_of(slow)
    for a, b in zip(fast.components, slow.components, strict=True):
        np.testing.assert_array_equal(a.coefficients, b.coefficients)
    assert jpeg.rgb(fast).shape == (fast.height, fast.width, 3)


def test_extreme_bytes():
    for b in (0, 127, 128, 254, 255):
        payload = bytes([b]) * 640
        assert jpeg.payload_of(jpeg.read(jpeg.write_payload(payload))) == payload
    with pytest.raises(ValueError):
        jpeg.write_payload(b"abc")
    with pytest.raises(ValueError):
        jpeg.read(b"nothing")


def test_inverse_transform_is_the_cosine_transform():
    rng = np.random.default_rng(0)
    co = np.zeros((1, 64), np.int32)
    co[0, :20] = rng.integers(-60, 60, 20)
    c = jpeg.Component(1, 1, 1, 0, 1, 1, co)
    grid = np.zeros((8, 8))
    grid.ravel()[jpeg.ZIGZAG] = co[0]
    scale = np.array([np.sqrt(0.5), *[1] * 7])
    x = np.arange(8)
    wave = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * scale / 2
    want = np.clip(np.rint(wave @ grid @ wave.T + 128), 0, 255)
    assert np.abs(jpeg._plane(c, np.ones(64, np.int32)).astype(int) - want).max() <= 1


class _Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def data(self):
        b = np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)
        return np.packbits(b).tobytes().replace(b"\xff", b"\xff\x00")


def test_general_progressive_scans():
    """A small encoder with runs, end-of-band runs and refinements that find new coefficients."""
    rng = np.random.default_rng(7)
    n = 6
    co = np.where(rng.random((n, 64)) < 0.12, rng.integers(-9, 10, (n, 64)), 0).astype(np.int32)
    co[2, 1:] = 0
    co[3, 1:] = 0
    symbols = [r << 4 | s for r in range(16) for s in range(5)] + [r << 4 for r in range(1, 15)]
    symbols = list(dict.fromkeys(symbols))
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    code = {s: i for i, s in enumerate(symbols)}

    def size_bits(v):
        s = int(abs(v)).bit_length()
        return s, v if v > 0 else v + (1 << s) - 1

    def scan(dc, low, high, before, now, body):
        return jpeg._segment(jpeg.SOS, bytes([1, 1, 0, low, high, before << 4 | now])) + body

    first = _Bits()
    prev = 0
    for b in range(n):
        v = int(co[b, 0]) >> 1
        s, raw = size_bits(v - prev)
        first.put(code[s], 8), first.put(raw, s)
        prev = v
    low = _Bits()
    for b in range(n):
        low.put(int(co[b, 0]) & 1, 1)
    ac, run = _Bits(), 0

    def flush(bits):
        nonlocal run
        while run:
            r = run.bit_length() - 1
            bits.put(code[r << 4], 8), bits.put(run - (1 << r), r)
            run = 0

    half = np.sign(co) * (np.abs(co) >> 1)
    for b in range(n):
        zeros = 0
        for k in range(1, 64):
            v = int(half[b, k])
            if not v:
                zeros += 1
                continue
            flush(ac)
            while zeros > 15:
                ac.put(code[0xF0], 8)
                zeros -= 16
            s, raw = size_bits(v)
            ac.put(code[zeros << 4 | s], 8), ac.put(raw, s)
            zeros = 0
        if zeros:
            run += 1
    flush(ac)
    fine = _Bits()
    for b in range(n):
        pending, zeros, k = [], 0, 1
        last_new = max([k for k in range(1, 64) if abs(co[b, k]) == 1], default=0)
        while k < 64:
            v = int(co[b, k])
            if abs(v) > 1:
                pending.append(abs(v) & 1)
            elif v == 0:
                zeros += 1
                if zeros == 16 and k < last_new:
                    fine.put(code[0xF0], 8)
                    for p in pending:
                        fine.put(p, 1)
                    pending, zeros = [], 0
            else:
                fine.put(code[zeros << 4 | 1], 8), fine.put(int(v > 0), 1)
                for p in pending:
                    fine.put(p, 1)
                pending, zeros = [], 0
                if k == last_new:
                    k += 1
                    break
            k += 1
        if last_new == 0:
            k, pending = 1, []
        rest = [abs(int(co[b, j])) & 1 for j in range(max(k, 1) if last_new else 1, 64) if abs(co[b, j]) > 1]
        if last_new < 63:
            fine.put(code[0], 8)
            for p in rest:
                fine.put(p, 1)
    import struct

    head = b"\xff\xd8" + jpeg._QUANT + jpeg._segment(jpeg.SOF2, struct.pack(">BHHB", 8, 16, 24, 1) + bytes([1, 0x11, 0]))
    tables = jpeg._segment(jpeg.DHT, b"\x00" + table) + jpeg._segment(jpeg.DHT, b"\x10" + table)
    data = head + tables + scan(1, 0, 0, 0, 1, first.data()) + scan(0, 1, 63, 0, 1, ac.data()) + scan(1, 0, 0, 1, 0, low.data()) + scan(0, 1, 63, 1, 0, fine.data()) + b"\xff\xd9"
    np.testing.assert_array_equal(jpeg.read(data).components[0].coefficients, co)


def test_media_digests(spark):
    rows = media.media_digests(table(spark)).collect()
    assert len(rows) == 7
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (4,)}
    assert by[2]["payload_bytes"] == 64 and by[2]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and by[2]["tail_crc32"] == zlib.crc32(bytes(64))
    assert by[2]["feature"] == by[3]["feature"]
    dup = [tuple(r)[1:] for r in rows if r["doc_id"] == 4 and r["n_bytes"] == 3]
    assert dup[0] == dup[1]
    stored = media.store(table(spark))
    shapes = media.tensors(stored).collect()
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] for r in shapes)
    assert media.media_digests(table(spark).where("false")).count() == 0


def test_trees_and_thresholds_learn_from_all_documents(spark, monkeypatch):
    seen = []
    boost, threshold = personal.boost, personal.threshold
    monkeypatch.setattr(personal, "boost", lambda rows: seen.extend(rows) or boost(rows))
    monkeypatch.setattr(personal, "threshold", lambda model, rows, precision: seen.extend(rows) or threshold(model, rows, precision))
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("from 10.1.2.7").alias("text"))
    personal.fit(df.union(spark.createDataFrame([(None, "from 10.1.2.7")], "doc_id long, text string")))
    assert sum(n for _, _, n in seen) == 2 * 50_001  # each address as it is and in disguise

"""Nearest neighbours by shifted Hilbert curves, completed to exact results.

Vectors are projected to a few directions (principal ones of a bounded sample), rotated and shifted anew for
each of several orderings, and sorted by their place on a Hilbert curve, with Spark's range partitioning. In each ordering a query is
compared with the rows in the windows beside its key; the windows' results merge to a first list of
neighbours, whose last score is a bound that all true neighbours reach.

A window ends where Spark's range of an ordering ends; the other orderings have their borders elsewhere.

The curve's first ordering also cuts the rows to blocks with a centre and a radius. No row of a block can score more
with a query than |query| * radius + query . centre; blocks that cannot reach the query's bound are skipped, all
others are compared in full, in blocks of queries. So nothing is missed: recall is 1. How much is skipped depends on
the data; where vectors spread evenly in all directions (as random ones do) the bounds skip little, and the work
is that of comparing the stated queries with all rows. The two sides meet in a grid of cells: a block of rows is
copied to every column of the grid, a block of queries to every row of it, and the grid has the shape that copies least, so
that for T cells the copies grow as the square root of T.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths have no inner
product, so every length is searched by itself. A null id takes no part. Repeated rows are candidates by themselves (a query's own
row is not); a query id that is repeated gives one list for each row. Ties go to the smaller id. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import Scratch, map_arrow, ship

#: Rows of the sample on which directions are fitted, about.
SAMPLE = 8_192
#: Directions of a curve, bits of each, orderings, and rows on either side of a query in a window.
DIRECTIONS, BITS, ORDERINGS, BESIDE = 6, 8, 4, 256
#: Rows of a block, and queries of a block.
BLOCK = 1_024
#: Pairs of a query and a row that a cell of the grid compares, about, and the least number of cells.
CELL, CELLS = 1 << 30, 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cells (rows x directions, each below 2 ** bits)."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:  # undo the curve's turns, from the coarsest level
        p = q - one
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where(x[n - 1] & q, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """Directions and cell edges of all orderings, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(axis=0)
        d = min(DIRECTIONS, sample.shape[1])
        _, _, axes = np.linalg.svd(sample - self.centre, full_matrices=False)
        axes = axes[: max(d, min(len(axes), 4 * d))]
        self.axes, self.edges, self.shifts = [], [], []
        for k in range(ORDERINGS):
            turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0] if k else np.eye(len(axes))
            own = (turn @ axes)[:d]
            self.axes.append(own)
            placed = (sample - self.centre) @ own.T
            half = 1 << (BITS - 1)  # a grid of half the curve's width, shifted within it
            self.shifts.append(rng.integers(0, half, d) if k else np.zeros(d, np.int64))
            self.edges.append(np.quantile(placed, np.arange(1, half) / half, axis=0))

    def keys(self, rows: np.ndarray, k: int) -> np.ndarray:
        placed = (rows - self.centre) @ self.axes[k].T
        cells = np.stack([np.searchsorted(self.edges[k][:, i], placed[:, i], side="right") + self.shifts[k][i] for i in range(placed.shape[1])], axis=1)
        return hilbert(cells, BITS)


def inner(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner product of each row of one with the same row of two, component after component in double precision."""
    total = np.zeros(len(one))
    for k in range(one.shape[1]):
        total += one[:, k] * two[:, k]
    return total


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"))


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark)
    rows = _valid(df, id_col, vector_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size, n in sorted(tuple(r) for r in rows.groupBy(F.size("v").alias("s")).count().collect()):
        out = out.unionByName(_search(rows.where(F.size("v") == size), size, n, k, every))
    return out


def grid(n: int, asked: int) -> tuple[int, int]:
    """Rows and columns of the grid in which n rows, cut over its rows, meet the queries, cut over its columns."""
    cells = max(CELLS, -(-n * asked // CELL))
    down = min(max(1, -(-n // BLOCK)), max(1, round((cells * n / max(1, asked)) ** 0.5)))
    return down, max(1, min(-(-asked // BLOCK), -(-cells // down)))


def _search(rows: DataFrame, size: int, n: int, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    take = min(1_000_000, 1_000_000 * SAMPLE // n + 1)
    sample = np.array([r["v"] for r in rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < take).limit(4 * SAMPLE).collect()] or [r["v"] for r in rows.limit(SAMPLE).collect()])
    curves = spark.sparkContext.broadcast(Curves(sample))

    def place(batches):
        for b in batches:
            v = _vectors(b.column("v"))
            keys = [pa.array(curves.value.keys(v, i)) for i in range(ORDERINGS)]
            yield pa.RecordBatch.from_arrays([*b.columns, *keys], [*b.schema.names, *(f"key{i}" for i in range(ORDERINGS))])

    placed = scratch.save(map_arrow(rows, place, "vec_id long, v array<double>, row long, " + ", ".join(f"key{i} long" for i in range(ORDERINGS))), "placed")
    scratch.drop("rows")
    parts = max(1, -(-n // (16 * BLOCK)))

    seeds = None
    for i in range(ORDERINGS):
        ordered = placed.select("vec_id", "v", "row", F.col(f"key{i}").alias("key")).repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
        found = map_arrow(ordered, lambda it: _windows(it, every, k), "query long, query_id long, vec_id long, other long, score double")
        seeds = found if seeds is None else seeds.unionByName(found)
    seeds = scratch.save(seeds.dropDuplicates(["query", "other"]), "seeds")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "other")
    bounds = seeds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("c"))
    bounds = bounds.select(F.col("query").alias("row"), F.when(F.col("c") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("bound"))

    ordered = placed.select("vec_id", "v", "row", F.col("key0").alias("key")).repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    blocks = map_arrow(ordered, _blocks, "vec_ids binary, rows binary, m binary, centre binary, radius double, block long")
    asked = placed.where(F.col("vec_id") % every == 0)
    wanted = asked.count()
    asked = asked.select("vec_id", "v", "row", F.col("key0").alias("key")).join(bounds, "row", "left").select("vec_id", "v", "row", "key", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    asked = asked.repartitionByRange(max(1, -(-wanted // (4 * BLOCK))), "key", "row").sortWithinPartitions("key", "row")
    questions = map_arrow(asked, _questions, "q_ids binary, q_rows binary, q binary, bounds binary, question long")
    # the stated queries, in blocks, with all rows, in blocks
    down, across = grid(n, wanted)

    def cell(own: str, cells: int, name: str):
        return F.pmod(F.xxhash64(own), F.lit(cells)).cast("int").alias(name)

    def every_one(cells: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias(name)

    left = blocks.select("*", cell("block", down, "y")).select("*", every_one(across, "x")).drop("block")
    right = questions.select("*", cell("question", across, "x")).select("*", every_one(down, "y")).drop("question")
    found = map_arrow(left.join(right, ["x", "y"]).drop("x", "y"), lambda it: _compare(it, size, k), "query long, query_id long, vec_id long, other long, score double")
    last = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "other")
    ranked = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    result = scratch.save(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "result")
    scratch.drop("placed", "seeds")
    return result


_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])


def _windows(batches: Iterator[pa.RecordBatch], every: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best rows within BESIDE places of each query in this part of an ordering."""
    held: list[tuple] = []  # the rows that later queries may still need, and queries that wait for later rows

    def flush(last: bool):
        ids, rows, v = (np.concatenate(x) for x in zip(*held, strict=True))
        end = len(ids) if last else max(0, len(ids) - BESIDE)
        start = flush.done
        for q in np.flatnonzero(ids[start:end] % every == 0) + start:
            a, b = max(0, q - BESIDE), min(len(ids), q + BESIDE + 1)
            near = np.r_[a:q, q + 1 : b]
            if len(near):
                rough = v[near] @ v[q]  # ranks the window; what is passed on is scored exactly
                best = near[_best(rough, ids[near], k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), rows[q])), pa.array(np.full(len(best), ids[q])), pa.array(ids[best]), pa.array(rows[best]), pa.array(inner(np.broadcast_to(v[q], (len(best), v.shape[1])), v[best]))], schema=_FOUND)
        keep = max(0, end - BESIDE)
        held[:] = [(ids[keep:], rows[keep:], v[keep:])]
        flush.done = end - keep

    flush.done = 0
    for b in batches:
        if len(b):
            held.append((b.column("vec_id").to_numpy(), b.column("row").to_numpy(), _vectors(b.column("v"))))
            yield from flush(False)
    if held:
        yield from flush(True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of BLOCK rows, the last of a part shorter."""
    held, n = [], 0
    for b in batches:
        while len(b):
            some = b.slice(0, BLOCK - n)
            held.append(some)
            n, b = n + len(some), b.slice(len(some))
            if n == BLOCK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _cut(batches):
        v = _vectors(t.column("v").chunk(0))
        centre = v.mean(axis=0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1).max()))
        ids, rows = t.column("vec_id").to_numpy(), t.column("row").to_numpy()
        yield pa.RecordBatch.from_pylist([{"vec_ids": ids.tobytes(), "rows": rows.tobytes(), "m": v.tobytes(), "centre": centre.tobytes(), "radius": radius, "block": int(rows[0])}])


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _cut(batches):
        v = _vectors(t.column("v").chunk(0))
        yield pa.RecordBatch.from_pylist([{"q_ids": t.column("vec_id").to_numpy().tobytes(), "q_rows": t.column("row").to_numpy().tobytes(), "q": v.tobytes(), "bounds": t.column("bound").to_numpy().tobytes(), "question": int(t.column("row")[0].as_py())}])


class _Lists:
    """The best k rows found so far for each query of a block, in one task."""

    def __init__(self, r: dict, size: int, k: int):
        self.k = k
        self.q = np.frombuffer(r["q"]).reshape(-1, size)
        self.q_ids, self.q_rows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64)
        self.norms = np.sqrt((self.q * self.q).sum(axis=1))
        self.bounds = np.frombuffer(r["bounds"]).copy()
        shape = (len(self.q), k)
        self.scores, self.ids, self.rows = np.full(shape, -np.inf), np.full(shape, 2**63 - 1), np.full(shape, -1)

    def add(self, r: dict) -> None:
        """Compare with a block of rows; queries that it cannot reach are left out."""
        ids, rows = np.frombuffer(r["vec_ids"], np.int64), np.frombuffer(r["rows"], np.int64)
        m = np.frombuffer(r["m"]).reshape(len(ids), -1)
        slack = 1e-9 * (1 + np.abs(self.q).max() * np.abs(m).max() * m.shape[1])
        most = self.q @ np.frombuffer(r["centre"]) + r["radius"] * self.norms
        open_ = np.flatnonzero(most + slack >= self.bounds)
        if not len(open_):
            return
        rough = self.q[open_] @ m.T
        rough[self.q_rows[open_][:, None] == rows[None, :]] = -np.inf
        least = self.bounds[open_]
        if rough.shape[1] > self.k:
            least = np.maximum(least, np.partition(rough, rough.shape[1] - self.k, axis=1)[:, -self.k])
        at, col = np.nonzero((rough >= least[:, None] - slack) & np.isfinite(rough))
        if not len(at):
            return
        # exact scores decide, in one order with what was found before; equal scores go to the smaller id
        touched = np.unique(at)
        old = open_[touched]
        place = np.concatenate([np.repeat(np.arange(len(old)), self.k), np.searchsorted(touched, at)])
        scores = np.concatenate([self.scores[old].ravel(), inner(self.q[open_[at]], m[col])])
        ids_, rows_ = np.concatenate([self.ids[old].ravel(), ids[col]]), np.concatenate([self.rows[old].ravel(), rows[col]])
        order = np.lexsort((rows_, ids_, -scores, place))
        first = np.searchsorted(place[order], np.arange(len(old)))
        best = order[first[:, None] + np.arange(self.k)[None, :]]
        self.scores[old], self.ids[old], self.rows[old] = scores[best], ids_[best], rows_[best]
        self.bounds[old] = np.maximum(self.bounds[old], self.scores[old, -1])

    def found(self) -> pa.RecordBatch:
        at, col = np.nonzero(self.rows >= 0)
        return pa.RecordBatch.from_arrays([pa.array(self.q_rows[at]), pa.array(self.q_ids[at]), pa.array(self.ids[at, col]), pa.array(self.rows[at, col]), pa.array(self.scores[at, col])], schema=_FOUND)


#: Queries whose lists a task holds before it passes them on.
HELD = 100_000


def _compare(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best k rows, of the row blocks that a task reads, for each query that they can reach."""
    held: dict[bytes, _Lists] = {}
    for b in batches:
        for i in range(len(b)):
            r = b.slice(i, 1).to_pylist()[0]
            key = r["q_rows"]
            if key not in held:
                if sum(len(x.q) for x in held.values()) >= HELD:
                    yield from (x.found() for x in held.values())
                    held.clear()
                held[key] = _Lists(r, size, k)
            held[key].add(r)
    yield from (x.found() for x in held.values())


def oracle_sql(k: int = 20, every: int = 20) -> str:
    """The same result in DuckDB SQL."""
    return f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score,
                      row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
               FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM scored WHERE rank <= {k}"""

"""Similarity join on word shingles: all texts whose shingle sets overlap by 0.8 or more, and their groups.

1. One pass hashes every whole text to its set of 5-word shingles. Texts with equal sets are one class, known
   by a hash of the set; a class also gets its size and a parity sketch (one bit for each of 4 to 8 times as many
   hash partitions as it has shingles). The pass also reports shingles that are frequent in a task.
2. A second pass sorts each set rare-first (unreported shingles before reported ones, those by their count) and
   emits its prefix: two sets that are similar enough share a shingle of their prefixes.
3. Classes that share a prefix shingle are candidates if length and positional bounds allow. Candidates are
   tested by the parity sketches, which bound the sets' Hamming distance from below (the suffix filter, on all of
   the set), and those left are verified exactly on their sets, once for each pair.
   Shingles that more than ``BIG`` classes share are compared in blocks of classes: pairs that the bounds rule out never become rows.
4. A large group of near copies would make pairs without number, most of which say nothing new. So pairs with
   the first class of each shingle's group are verified first, and neighbours in a few random orders as long as many
   pairs are open. Classes that are linked by then need not be compared again. Last, every pair that is still open
   (classes in different components that share a prefix shingle) is verified: the components are exact.

Nothing is capped or sampled: rarity only orders shingles, whatever the order is the result is the same.

Nulls and odd rows: a null, empty or blank text has no shingles and is linked with nothing; a text of fewer than
five words has one shingle, all its words. Repeated rows are one class, so they share a component. A null id
gives a row with its component's least id, null if it has none. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import BROADCAST_IDS, Scratch, chunks, id_text, map_arrow, ship
from ripplemark.llm.components import components
from ripplemark.llm.shingles import mix, shingle_sets

#: Similar: SHARE hundredths of the union or more.
SHARE = 80
#: Buckets in which a task counts shingles; those of REPORTED and 3 times the mean count or more are reported.
COUNT_BITS, REPORTED = 24, 4
#: Classes that one group of a frequent shingle holds about, at most.
SALTED = 20_000
#: Classes that share a shingle, above which they are compared in blocks.
BIG = 256
#: Blocks of a shingle that one task compares with all others of it, about.
TASK_BLOCKS = 64
#: Open pairs for each row from which neighbours in random orders are tried first.
MANY_OPEN = 32
#: Frequent buckets that order shingles; the most frequent ones. The others go first, which changes no result.
BROADCAST_BUCKETS = 1 << 20
#: Characters whose words are hashed at once: arrays of 8 bytes a character.
CHUNK = 300_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_key(s: np.ndarray) -> int:
    """A hash of a set of hashes."""
    with np.errstate(over="ignore"):
        total = mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)
        return int(_signed(mix(np.array([total], np.uint64)))[0])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of 4 to 8 times as many partitions, a power of two."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def far_apart(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """Whether the sketches show that two sets are not similar: their symmetric difference has at least as many
    elements as there are partitions of different parity."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # fold the longer: partitions go by the low bits
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    most_shared = (n_a + n_b - apart) // 2
    return 100 * most_shared < SHARE * (n_a + n_b - most_shared)


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows) folded to so many bytes: partitions go by the low bits."""
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def close_pairs(one: list[dict], two: list[dict], same: bool) -> list[tuple[int, int]]:
    """Pairs (key, key) of two blocks of classes that share a shingle, are in different components and may be similar: by length, position and sketch.

    same: both blocks are one, whose pairs count once.
    """
    out = []

    def parts(block: list[dict]) -> dict[int, list[int]]:
        by: dict[int, list[int]] = {}
        for i, m in enumerate(block):
            by.setdefault(len(m["sketch"]), []).append(i)
        return by

    def column(block: list[dict], which: list[int], name: str) -> np.ndarray:
        return np.array([block[i][name] for i in which], np.int64)

    for size_a, ia in parts(one).items():
        for size_b, ib in parts(two).items():
            if max(size_a, size_b) > 4 * min(size_a, size_b):
                continue  # sizes whose sketches differ so much fail the length bound
            size = min(size_a, size_b)
            a = _folded(np.frombuffer(b"".join(one[i]["sketch"] for i in ia), np.uint8).reshape(len(ia), size_a), size)
            b = _folded(np.frombuffer(b"".join(two[i]["sketch"] for i in ib), np.uint8).reshape(len(ib), size_b), size)
            na, nb, pa_, pb = column(one, ia, "n")[:, None], column(two, ib, "n")[None, :], column(one, ia, "pos")[:, None], column(two, ib, "pos")[None, :]
            most = np.minimum(np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb), np.minimum(na, nb))
            ok = (most * (100 + SHARE) >= (na + nb) * SHARE) & (column(one, ia, "component")[:, None] != column(two, ib, "component")[None, :])
            ka, kb = column(one, ia, "key"), column(two, ib, "key")
            if same:
                ok &= ka[:, None] < kb[None, :]
            for i in np.flatnonzero(ok.any(axis=1)):
                js = np.flatnonzero(ok[i])
                apart = np.bitwise_count(a[i][None, :] ^ b[js]).sum(axis=1, dtype=np.int64)
                shared = (na[i, 0] + nb[0, js] - apart) // 2
                out += [(int(ka[i]), int(kb[j])) for j in js[100 * shared >= SHARE * (na[i, 0] + nb[0, js] - shared)]]
    return out


def prefix_length(n: int) -> int:
    """Shingles of a set of n of which a similar set shares one, in any fixed order."""
    return n - -(-SHARE * n // 100) + 1


def _profile(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n, key, sketch of every text; and rows with bucket, count of frequent shingles (others null)."""

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.uint16)  # a task's documents; more of them than fit are no rarer
        seen: set[int] = set()
        names = ["doc_id", "h", "n", "key", "sketch", "bucket", "count"]
        for part, texts in chunks(batches, "text", CHUNK):
            sets = shingle_sets(texts)
            keys = [set_key(s) for s in sets]
            for k, s in zip(keys, sets, strict=True):
                if k not in seen:  # copies in a task count once
                    seen.add(k)
                    at = (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                    counts[at] += counts[at] < 65_000
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h"), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()), none, none],
                names,
            )
        often = np.flatnonzero(counts >= REPORTED + 3 * counts.mean()).astype(np.int32)
        n = len(often)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(often), pa.array(counts[often].astype(np.int32))], names)

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), run, "doc_id long, h long, n int, key long, sketch binary, bucket int, count int")


def _prefixes(docs: DataFrame, frequent) -> DataFrame:
    """gram, salt, key, n, pos: the rare-first prefix of every class. frequent: broadcast buckets and counts.

    salt: from 1 for shingles that are split into several groups, 0 for others.
    """

    def run(batches):
        buckets, counts = frequent.value
        buckets, counts = np.append(buckets, np.int32(1 << COUNT_BITS)), np.append(counts, np.int32(0))
        seen: set[int] = set()
        for _, texts in chunks(batches, "text", CHUNK):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in shingle_sets(texts):
                if not len(s):
                    continue
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                n, p = len(s), prefix_length(len(s))
                own = (s >> np.uint64(64 - COUNT_BITS)).astype(np.int32)
                place = np.searchsorted(buckets, own)
                often = np.where(buckets[place] == own, counts[place], 0)
                order = np.lexsort((s, often))[:p]
                salts = 1 + often[order] // SALTED
                salt = np.where(salts > 1, 1 + (key & 0x7FFFFFFF) % salts, 0)
                for c, x in zip(columns, (_signed(s[order]), salt, np.full(p, key), np.full(p, n), np.arange(p)), strict=True):
                    c.append(x)
            if columns[0]:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(columns, kinds, strict=True)], ["gram", "salt", "key", "n", "pos"])

    return map_arrow(docs.select("text"), run, "gram long, salt int, key long, n int, pos int")


def _possible(a: str, b: str):
    """Length and positional bounds for two classes that share a shingle: n and pos of either."""
    n_a, n_b, p_a, p_b = (F.col(f"{x}.{c}").cast("long") for c in ("n", "pos") for x in (a, b))
    most = F.least(p_a, p_b) + 1 + F.least(n_a - p_a, n_b - p_b) - 1
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * SHARE) & (most * (100 + SHARE) >= (n_a + n_b) * SHARE)


class JaccardJoin:
    """A run of the join over one table."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = df.sparkSession
        ship(self.spark)
        self.scratch = Scratch(self.spark, "jaccard")
        self.docs = id_text(df, id_col, text_col)

    def run(self) -> DataFrame:
        """doc_id, h, n, first (doc_id and h of the row that stands for its component, null without shingles), component_id (the least doc_id) for every row."""
        scratch = self.scratch
        profile = scratch.save(_profile(self.docs), "profile")
        own = profile.where("bucket is null")
        found = profile.where("bucket is not null").groupBy("bucket").agg(F.least(F.sum("count"), F.lit(2**31 - 1)).cast("int").alias("count"))
        found = found.orderBy(F.desc("count"), "bucket").limit(BROADCAST_BUCKETS).toPandas()  # 8 bytes a row
        found = found.sort_values("bucket")
        frequent = self.spark.sparkContext.broadcast((found["bucket"].to_numpy(np.int32), found["count"].to_numpy(np.int32)))
        classes = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"))
        self.classes = scratch.save(classes, "classes")
        self._groups(frequent)
        comp = self._resolve()
        # a component's id is the least doc_id of its classes
        labelled = self.classes.select("key", "doc", "first").join(comp, F.col("key") == F.col("node"), "left").select("key", "doc", "first", F.coalesce("component", "key").alias("component"))
        least = labelled.groupBy("component").agg(F.min("doc").alias("component_id"), F.min("first").alias("first"))
        of_class = scratch.save(labelled.drop("first").join(least, "component").select("key", "first", "component_id"), "result")
        self.scratch.keep("profile", "result")
        joined = own.where("n > 0").select("doc_id", "h", "n", "key").join(of_class, "key").select("doc_id", "h", "n", "first", "component_id")
        alone = own.where("n = 0").select("doc_id", "h", "n", F.lit(None).cast(dict(of_class.dtypes)["first"]).alias("first"), F.col("doc_id").alias("component_id"))
        return joined.unionByName(alone)

    def _groups(self, frequent) -> None:
        """Rows of prefix shingles that two classes or more share, each with the first class of its group."""
        rows = _prefixes(self.docs, frequent)
        whole = Window.partitionBy("gram", "salt").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        running = Window.partitionBy("gram", "salt").orderBy("key")
        marked = rows.select(
            "*",
            F.first(F.struct("key", "n", "pos")).over(whole).alias("hub"),
            F.last("key").over(whole).alias("last"),
            F.lag("key").over(running).alias("before"),
        )
        # salted groups are kept even if they hold one class: their shingle may have others
        kept = marked.where("(hub.key <> last or salt > 0) and (before is null or before <> key)").drop("last", "before")
        self.grouped = self.scratch.save(kept, "grouped")

    def _resolve(self) -> DataFrame:
        """node, component of all classes that are linked."""
        rows = self.grouped
        first = rows.where("key <> hub.key").select("key", "n", "pos", F.col("hub.key").alias("hub_key"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
        first = first.select(F.struct("key", "n", "pos").alias("x"), F.struct(F.col("hub_key").alias("key"), F.col("hub_n").alias("n"), F.col("hub_pos").alias("pos")).alias("y"))
        tried, links = self._verify(first, "hubs")
        comp = components(links, self.scratch, "comp-hubs")
        before = None
        for k in range(1, 8):
            state, open_pairs, n_rows = self._open(comp, k)
            # more random neighbours help while groups are large and the last ones closed many pairs
            if open_pairs <= MANY_OPEN * n_rows or k == 7 or (before and open_pairs > 0.7 * before):
                break
            before = open_pairs
            near = Window.partitionBy("gram", F.pmod(F.xxhash64("key", F.lit(-k)), F.col("salts"))).orderBy(F.xxhash64("key", F.lit(k)))
            ahead = state.select("*", *(F.lead(F.struct("key", "n", "pos", "component"), d).over(near).alias(f"y{d}") for d in (1, 2, 3)))
            pairs = None
            for d in (1, 2, 3):
                some = ahead.where(f"y{d} is not null and y{d}.component <> component").select(F.struct("key", "n", "pos").alias("x"), F.col(f"y{d}").alias("y"))
                pairs = some if pairs is None else pairs.unionByName(some)
            more, links = self._verify(pairs, f"near{k}", but=tried)
            tried = tried.unionByName(more)
            comp = components(self._with(comp, links), self.scratch, f"comp-near{k}")
        # all that is left: a class outside a shingle's largest component, with every class of another component
        few = state.where(F.col("all") <= BIG)
        x, y = few.where("not main").alias("x"), few.alias("y")
        rest = x.join(y, F.col("x.gram") == F.col("y.gram")).where((F.col("x.component") != F.col("y.component")) & (F.col("y.main") | (F.col("x.key") < F.col("y.key"))) & _possible("x", "y"))
        rest = rest.select(F.struct("x.key", "x.n", "x.pos").alias("x"), F.struct("y.key", "y.n", "y.pos").alias("y"))
        _, links = self._verify(rest, "rest", but=tried, more=self._block_pairs(state.where(F.col("all") > BIG)))
        return components(self._with(comp, links), self.scratch, "comp-rest")

    @staticmethod
    def _with(comp: DataFrame, links: DataFrame) -> DataFrame:
        """New links, and one for each class that says which component it is in."""
        return comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)

    def _block_pairs(self, state: DataFrame) -> DataFrame:
        """a, b: pairs that are left of shingles with many classes, compared block by block, so that no row is made of a pair that its sketches rule out."""
        members = state.join(self.classes.select("key", "sketch"), "key")
        members = members.withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("all") / 128)))
        blocks = members.groupBy("gram", "main", "part").agg(F.collect_list(F.struct("key", "n", "pos", "component", "sketch")).alias("m"))  # about 128 by the hash
        blocks = self.scratch.save(blocks, "blocks")
        # a shingle's blocks meet in several tasks, at most the root of their number: one side is dealt out, the other copied
        number = blocks.groupBy("gram").agg(F.least(F.ceil(F.sqrt(F.count("*"))), F.ceil(F.count("*") / TASK_BLOCKS)).cast("int").alias("tasks"))
        blocks = blocks.join(number, "gram")
        x = blocks.where("not main").withColumn("task", F.pmod(F.xxhash64("part"), F.col("tasks")).cast("int")).alias("x")
        y = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).alias("y")
        pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.task") == F.col("y.task"))).where(F.col("y.main") | (F.col("x.part") <= F.col("y.part")))
        pairs = pairs.select(F.col("x.m").alias("one"), F.col("y.m").alias("two"), (~F.col("y.main") & (F.col("x.part") == F.col("y.part"))).alias("same"))

        def run(batches):
            for b in batches:
                for i in range(len(b)):
                    r = b.slice(i, 1).to_pylist()[0]
                    found = close_pairs(r["one"], r["two"], r["same"])
                    if found:
                        a, c = np.array(found, np.int64).T
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

        spark, key = self.spark, "spark.sql.execution.arrow.maxRecordsPerBatch"
        frame = map_arrow(pairs, run, "a long, b long")
        before = spark.conf.get(key)
        spark.conf.set(key, "8")  # a row holds two blocks
        try:
            return self.scratch.save(frame.distinct(), "block-pairs")
        finally:
            spark.conf.set(key, before)

    def _open(self, comp: DataFrame, k: int) -> tuple[DataFrame, int, int]:
        """Rows of shingles whose classes are in several components, with the component, whether it is the shingle's
        largest (main), and how many groups a salted shingle has; the number of open pairs; and of rows."""
        rows = self.grouped.select("gram", "salt", "key", "n", "pos").join(comp, F.col("key") == F.col("node"), "left")
        rows = rows.select("gram", "salt", "key", "n", "pos", F.coalesce("component", "key").alias("component"))
        sizes = rows.groupBy("gram", "component").agg(F.count("*").alias("c"), F.max("salt").alias("s"))  # partial sums: a hot shingle is no hot task
        grams = sizes.groupBy("gram").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("parts"), F.greatest(F.max("s"), F.lit(1)).alias("salts")).where("parts > 1")
        state = rows.join(grams, "gram").select("gram", "key", "n", "pos", "component", (F.col("component") == F.col("top.component")).alias("main"), F.col("all"), "salts")
        state = self.scratch.save(state, f"open{k}")
        self.scratch.drop(f"open{k - 1}")
        total = state.agg(F.sum(F.when(F.col("main"), 0).otherwise(F.col("all"))), F.count("*")).first()
        return state, total[0] or 0, total[1]

    def _verify(self, pairs: DataFrame, name: str, but: DataFrame | None = None, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The pairs that were tried and the links among them, of candidate pairs (x, y: structs of key, n, pos; more: pairs a, b that passed the bounds)
        but those that were tried before."""
        scratch, spark = self.scratch, self.spark
        pairs = pairs.where(_possible("x", "y")).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        pairs = (pairs if more is None else pairs.unionByName(more)).distinct()
        if but is not None:
            pairs = pairs.join(but, ["a", "b"], "left_anti")
        tried = scratch.save(pairs, f"{name}-pairs")
        side = self.classes.select("key", "doc", "n", "sketch")

        def of(c: str) -> DataFrame:
            return side.select(*(F.col(x).alias(c if x == "key" else f"{x}_{c}") for x in side.columns))

        def near(batches):
            for b in batches:
                cols = [b.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")]
                keep = [not far_apart(*x) for x in zip(*cols, strict=True)]
                yield b.filter(pa.array(keep)).select(["a", "b"])

        close = map_arrow(tried.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b"), near, "a long, b long")
        close = scratch.save(close, f"{name}-close")
        needed = close.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(self.classes.select("key", "doc"), "key")
        needed = scratch.save(needed, f"{name}-needed")
        # a class whose ids are all null has no document to look up by id: its texts are found by their hash below
        small = needed.count() <= BROADCAST_IDS
        ids = needed.where("doc is not null").select(F.col("doc").alias("doc_id")).distinct()
        texts = self.docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
        if needed.where("doc is null").limit(1).count():
            texts = texts.unionByName(self.docs.where("doc_id is null"))

        def sets(batches):
            for _, ts in chunks(batches, "text", CHUNK):
                made = [s for s in shingle_sets(ts) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], ["key", "items"])

        held = map_arrow(texts.select("text"), sets, "key long, items binary").join(needed.select("key"), "key", "left_semi").dropDuplicates(["key"])

        def verify(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column("items_a").to_pylist(), b.column("items_b").to_pylist(), strict=True):
                    one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(100 * shared >= SHARE * (len(one) + len(two) - shared))
                yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        held = scratch.save(held, f"{name}-sets")
        one = held.select(F.col("key").alias("a"), F.col("items").alias("items_a"))
        two = held.select(F.col("key").alias("b"), F.col("items").alias("items_b"))
        links = map_arrow(close.join(one, "a").join(two, "b").select("a", "b", "items_a", "items_b"), verify, "a long, b long")
        links = scratch.save(links, f"{name}-links")
        scratch.drop(f"{name}-sets", f"{name}-close", f"{name}-needed")
        return tried, links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the least doc_id that its links reach."""
    return JaccardJoin(df, id_col, text_col).run().select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that with the least id (null ids last), among its texts that with the least hash. Rows without a shingle stay; all columns stay.

    Rows are told apart by id and text, so an id on rows of several groups loses only those that are copies; of rows that agree in both, any one stays.
    """
    found = JaccardJoin(df, id_col, text_col).run().where("first is not null")
    gone = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")))
    placed = found.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.max(gone).alias("gone"), F.count("*").alias("rows"))
    here = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__h"))

    def side(rows: DataFrame) -> DataFrame:
        few = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return F.broadcast(rows) if few else rows

    kept = df.join(side(placed.where("gone").select("__id", "__h")), here, "left_anti")
    repeated = placed.where("not gone and rows > 1").select("__id", "__h")
    if repeated.isEmpty():
        return kept
    repeated = side(repeated)
    once = kept.join(repeated, here, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, here, "left_anti").unionByName(once)

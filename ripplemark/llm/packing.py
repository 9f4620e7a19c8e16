"""Best-fit packing of documents into fixed-size sequences by a grouping genetic algorithm.

``tokenize`` turns every whole text into ids, ends it with a separator id and cuts only documents
longer than a sequence: all pieces but the first are exactly one sequence long. Full pieces are
sequences by themselves. The others are packed on islands:

* pieces go to islands by a hash of their row number, so islands are of even size whatever source or
  group of copies a piece is from;
* an island starts from best-fit decreasing and from packings that fill one sequence after the other as full as a short
  search can. A child takes a run of
  well-filled sequences whole from one parent, then the sequences of the other parent that are still
  possible (those that would repeat a piece are taken apart), and best-fits the displaced pieces.
  A mutation takes the worst-filled sequences of a child and a few others apart and fills them anew, the fullest first; a child that
  is no better stays out. An island stops as soon as it reaches the lower bound ceil(sum / size);
* after each epoch the worst-filled sequences of each island's best packing migrate whole, together
  with their elite order, to one of fewer islands, which evolve them further. A migrant quota keeps
  every island within its size, so no task grows with the input, and the last epoch has one island.

Nulls and odd rows: a null text is empty and makes one piece holding the separator; null and repeated
ids are kept, each row makes its own pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import Scratch, chunks, id_text, map_arrow

#: Pieces on an island.
ISLAND = 65_536
#: Islands whose migrants meet on one island of the next epoch.
MERGED = 64
POPULATION, GENERATIONS = 5, 8

Bins = list[tuple[int, ...]]


# -- islands: plain Python over piece lengths; pieces of equal length can stand for each other --


def best_fit(items: Iterable[int], bins: Bins, size: int) -> Bins:
    """Add items, in the order given, to the fullest sequence that still takes them; open one if none does."""
    out = [list(b) for b in bins]
    room: dict[int, list[int]] = {}
    free = 0  # bit r: a sequence with r tokens left exists
    for i, b in enumerate(out):
        if r := size - sum(b):
            room.setdefault(r, []).append(i)
            free |= 1 << r
    for n in items:
        if fits := free >> n:
            r = n + (fits & -fits).bit_length() - 1
            i = room[r].pop()
            if not room[r]:
                free ^= 1 << r
            out[i].append(n)
            left = r - n
        else:
            i, left = len(out), size - n
            out.append([n])
        if left:
            room.setdefault(left, []).append(i)
            free |= 1 << left
    return [tuple(b) for b in out]


def fitness(bins: Bins, size: int) -> tuple[int, float]:
    """Fewer sequences first, then more uneven filling."""
    return -len(bins), sum((sum(b) / size) ** 2 for b in bins) / max(1, len(bins))


def crossover(one: Bins, two: Bins, size: int, rng: random.Random) -> Bins:
    """Inject a run of well-filled sequences of ``two`` whole, keep what still fits of ``one``, best-fit the rest."""
    donors = sorted(two, key=sum, reverse=True)[: max(1, len(two) * 2 // 3)]
    start = rng.randrange(len(donors))
    injected = donors[start : start + max(1, len(donors) // 2)]
    taken = Counter(n for b in injected for n in b)
    child, displaced = list(injected), []
    for b in sorted(one, key=sum, reverse=True):
        repeats = [n for n in b if taken[n] > 0]
        if not repeats:
            child.append(b)
            continue
        for n in b:
            if taken[n] > 0:
                taken[n] -= 1  # this piece is in an injected sequence already
            else:
                displaced.append(n)
    return best_fit(sorted(displaced, reverse=True), child, size)


def fullest(items: Iterable[int], size: int, rng: random.Random | None = None) -> Bins:
    """Fill one sequence after the other: the longest item left, then what fills it exactly alone or as a pair, else the longest
    that fits and so on. rng varies which pair it is."""
    left = Counter(items)
    there = back = 0  # bit n: an item of n tokens is left; the same mirrored, bit size - n
    for n in left:
        there |= 1 << n
        back |= 1 << (size - n)
    out: Bins = []
    while there:
        made, room = [], size
        found = [there.bit_length() - 1]
        while found:
            for n in found:
                made.append(n)
                room -= n
                left[n] -= 1
                if not left[n]:
                    there ^= 1 << n
                    back ^= 1 << (size - n)
            fits = there & ((2 << room) - 1)
            if not fits:
                break
            longest = fits.bit_length() - 1
            pairs = fits & (back >> (size - room))
            if room % 2 == 0 and left[room // 2] < 2:
                pairs &= ~(1 << (room // 2))
            if longest == room or not pairs:
                found = [longest]
            else:
                some = (pairs & rng.getrandbits(room + 1) if rng else 0) or pairs
                one = some.bit_length() - 1
                found = [one, room - one]
        out.append(tuple(made))
    return out


def mutated(bins: Bins, size: int, rng: random.Random) -> Bins:
    """The worst-filled sequences and a few others, filled anew."""
    worst_first = sorted(bins, key=sum)
    k = max(2, len(bins) // 20)
    others = worst_first[k:]
    rng.shuffle(others)
    loose = [n for b in worst_first[:k] + others[:k] for n in b]
    return others[k:] + min((fullest(loose, size, rng), best_fit(sorted(loose, reverse=True), [], size)), key=len)


def evolve(lengths: Sequence[int], size: int, seed: int, elite: Bins | None = None) -> Bins:
    """The best packing found for the pieces of an island; ``elite`` is one that migrated in."""
    if not lengths:
        return []
    rng = random.Random(seed)
    bound = -(-sum(lengths) // size)

    def rank(bins: Bins) -> tuple[int, float]:
        return fitness(bins, size)

    people = [best_fit(sorted(lengths, reverse=True), [], size)]
    if elite:
        people.append(elite)
    while len(people) < POPULATION and min(map(len, people)) > bound:
        people.append(fullest(lengths, size, rng if len(people) > 1 else None))
    for _ in range(GENERATIONS):
        people.sort(key=rank, reverse=True)
        if len(people[0]) == bound:
            break
        for _ in range(POPULATION - 1):
            one, two = rng.sample(people[: max(2, POPULATION // 2)], 2)
            child = mutated(crossover(one, two, size, rng), size, rng)
            worst = min(range(len(people)), key=lambda i: rank(people[i]))
            if rank(child) > rank(people[worst]):
                people[worst] = child
    return max(people, key=rank)


# -- tokens --


@lru_cache(maxsize=2)
def fast_encoder(ranks_path: str, special: str):
    """The byte-level vocabulary as ranks; gives the same ids as the tokenizers library with the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})


def tokenize(df: DataFrame, ranks_path: str, size: int = 1024, end_id: int = 2, special: str = "<|endoftext|>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""

    def run(batches):
        enc = fast_encoder(ranks_path, special)
        allowed = {special}
        for part, texts in chunks(batches, "text"):
            ids_of, rows = part.column("doc_id").to_pylist(), []
            for doc, text in zip(ids_of, texts, strict=True):
                ids = enc.encode(text, allowed_special=allowed) if special in text else enc.encode_ordinary(text)
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                cuts = [0, *range(len(ids) % size or min(size, len(ids)), len(ids), size), len(ids)]
                rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- epochs --


def _epoch(items: DataFrame, islands: int, epoch: int, size: int, last: bool) -> DataFrame:
    """One epoch on all islands. items: row, length, and the sequence it migrated with (null at first)."""
    quota = ISLAND // MERGED

    def run(key, pdf):
        island = int(key[0])
        pdf = pdf.sort_values("row", kind="stable")
        lengths = pdf["length"].tolist()
        elite = None
        if pdf["sequence"].notna().all():
            elite = [tuple(g) for _, g in pdf.groupby("sequence", sort=True)["length"]]
        bins = evolve(lengths, size, seed=epoch * 1_000_003 + island, elite=elite)
        rows_of: dict[int, list[int]] = {}
        for row, n in zip(pdf["row"].tolist()[::-1], lengths[::-1], strict=True):
            rows_of.setdefault(n, []).append(row)
        bins.sort(key=sum, reverse=True)
        leaving, moved = len(bins), 0
        if not last:
            while leaving and sum(bins[leaving - 1]) < size and moved + len(bins[leaving - 1]) <= quota:
                leaving -= 1
                moved += len(bins[leaving])
        out = []
        for i, b in enumerate(bins):
            at, number = 0, (epoch << 58) | (island << 18) | i
            for n in b:
                out.append((rows_of[n].pop(), n, number, at, i < leaving))
                at += n
        import pandas as pd

        return pd.DataFrame(out, columns=["row", "length", "sequence", "offset", "done"])

    dealt = items.withColumn("island", F.pmod(F.xxhash64("row", F.lit(epoch)), F.lit(islands)))
    if epoch:  # migrating sequences stay whole
        dealt = items.withColumn("island", F.pmod(F.xxhash64("sequence", F.lit(epoch)), F.lit(islands)))
    return dealt.groupBy("island").applyInPandas(run, "row long, length long, sequence long, offset long, done boolean")


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces with sequence_id and offset. pieces: length (1 to size) and any other columns but row, sequence_id and offset."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    numbered = scratch.save(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    items = numbered.where(F.col("length") < size).select("row", "length", F.lit(None).cast("long").alias("sequence"))
    islands = max(1, -(-items.count() // ISLAND))
    placed, epoch = [], 0
    while True:
        last = islands == 1
        result = scratch.save(_epoch(items, islands, epoch, size, last), f"epoch{epoch}")
        placed.append(result.where("done").select("row", F.col("sequence").alias("sequence_id"), "offset"))
        if last:
            break
        items = result.where("not done").select("row", "length", "sequence")
        islands, epoch = -(-islands // MERGED), epoch + 1
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    full = numbered.where(F.col("length") >= size).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return numbered.where(F.col("length") < size).join(found, "row").unionByName(full).drop("row")


def pack_documents(df: DataFrame, ranks_path: str, size: int = 1024, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(tokenize(df, ranks_path, size, **columns), size)

"""Near copies by an LSH forest over MinHash signatures.

Every distinct shingle set gets one label per tree: a sequence of MinHash
values. Sorting a tree's labels puts sets with long common prefixes side by
side; a region is a run of labels with a common prefix. A small region gives
all its pairs; a larger one gives its neighbours and is then looked at one
value deeper, until its parts are small. The sets of those still large where
the labels end meet in a join on their rarest shingles. Pairs whose sizes
or sketches (a bit of every MinHash value, carried along in the sort) rule out
the asked similarity go, the rest are compared on their full sets, and links
are followed to connected components.

Sets that are equal are one set from the start, so a group of copies, however
large, takes part once. A sort has no groups: partitions end anywhere, and
the runs at such an end are put together in a second, small pass; runs too
long for one task meet on their rarest shingles too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import apart, keep_rows, row_key, sorted_rank, stage_table
from mensura.llm.graph import components

WORDS = 3
LEAST = 85           # per cent
TREES = 16
DEPTH = 10
#: Trees whose neighbours are joined first, before all trees look across what that joined.
FIRST_TREES = 4
#: Prefix length from which neighbours are candidates: at similarity s a pair shares it in a tree with chance s^3.
PREFIX = 3
#: A region gives all its pairs of different parts if they are at most so many per label; others go deeper.
REGION = 16
#: Labels to either side that a label meets in any case.
NEAR = 6
#: Labels of one run that a task looks at together; the sets of longer runs meet on their rarest shingles.
HELD = 1 << 14
#: Counts of shingles, in so many slots, tell the rare ones.
SLOTS = 1 << 20
#: Bits of the sketches of sets that meet on their rarest shingles, in whole longs.
BITS = 2048
#: Bits of the parity sketches of sets to be confirmed, in whole longs.
PARITY = 1024
#: Slots, in whole bitmaps of 4 KB, that tell the texts to be read again from most others.
NAMED = 1 << 25
#: Pairs whose sketches a task compares at a time.
PAIRS = 1 << 16
#: A sketch that differs in so many standard deviations more than asked rules a pair out.
DEVIATIONS = 6.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased and words are split at space and U+0009 to U+000D.
    Fewer words make one shingle of them all; none make an empty set.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], values: int, chunk: int = 1 << 15) -> np.ndarray:
    """16 bits of each of ``values`` MinHash values per non-empty set."""
    mults = multipliers(values)
    out = np.zeros((len(sets), values), dtype=np.uint16)
    at = 0
    while at < len(sets):
        stop, n = at, 0
        while stop < len(sets) and (stop == at or n + len(sets[stop]) <= chunk):
            n += len(sets[stop])
            stop += 1
        h = np.concatenate(sets[at:stop])
        starts = np.cumsum([0] + [len(s) for s in sets[at:stop - 1]])
        for k, m in enumerate(mults):
            out[at:stop, k] = (np.minimum.reduceat(h * m, starts) & np.uint64(0xFFFF)).astype(np.uint16)
        at = stop
    return out


def sketches(signature: np.ndarray) -> list[bytes]:
    """One bit of every MinHash value, packed: sets at similarity s differ in
    a bit with chance (1 - s) / 2."""
    return [x.tobytes() for x in np.packbits((signature >> 15).astype(np.uint8), axis=1)]


def most_bits(least: float, bits: int) -> int:
    """Bits in which two sets of the similarity (per cent) differ at most, with room for chance."""
    chance = (1 - least / 100) / 2
    return int(bits * chance + DEVIATIONS * (bits * chance * (1 - chance)) ** 0.5)


def neighbours(zones: np.ndarray, labels: np.ndarray, parts: np.ndarray, prefix: int = PREFIX, region: int = REGION,
               near: int = NEAR, rest: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of positions in sorted labels (rows of values), of
    different ``parts`` each.

    ``zones`` tells apart what must not meet (trees). Two neighbours that
    share ``prefix`` values are always a pair; with ``region`` 0 that is all.
    Otherwise each label also meets the next ``near`` that share the prefix,
    and a run of labels with a common prefix gives all its pairs of different
    parts if they are at most ``region`` per label, or is split by the next
    value. So the pairs are in proportion to the labels. The positions of
    regions that are still larger where the labels end are added to ``rest``.
    """
    n, depth = labels.shape
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    differ = labels[1:] != labels[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    common[zones[1:] != zones[:-1]] = -1
    left, right = [], []

    def runs(lo: int, hi: int, at: int):
        """Maximal runs in [lo, hi) whose neighbours share at least ``at`` values."""
        cuts = np.flatnonzero(common[lo:hi - 1] < at) + lo + 1
        for a, b in zip(np.concatenate([[lo], cuts]), np.concatenate([cuts, [hi]])):
            if b - a > 1:
                yield int(a), int(b)

    left.append(np.flatnonzero(common >= prefix))
    right.append(left[0] + 1)
    todo = [(a, b, prefix) for a, b in runs(0, n, prefix)] if region else []
    while todo:
        a, b, at = todo.pop()
        m = b - a
        _, inverse, sizes = np.unique(parts[a:b], return_inverse=True, return_counts=True)
        pairs = (m * m - int((sizes.astype(np.int64) ** 2).sum())) // 2
        if pairs <= region * m:
            # the largest part's labels meet all others; the others meet among themselves
            big = inverse == np.argmax(sizes)
            x, y = np.flatnonzero(big) + a, np.flatnonzero(~big) + a
            i, j = np.triu_indices(len(y), 1)
            left += [np.repeat(x, len(y)), y[i]]
            right += [np.tile(y, len(x)), y[j]]
        elif at < depth:
            todo += [(x, y, at + 1) for x, y in runs(a, b, at + 1)]
        elif rest is not None:
            rest.append(np.arange(a, b))
    shared = common
    for step in range(2, near + 1 if region else 0):
        shared = np.minimum(shared[:-1], common[step - 1:])
        left.append(np.flatnonzero(shared >= prefix))
        right.append(left[-1] + step)
    i, j = np.concatenate(left), np.concatenate(right)
    fit = parts[i] != parts[j]
    return i[fit], j[fit]


def _sets(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """``doc_id``, ``row_key``, ``n``, the set's 128-bit name, its labels and a sketch of them."""
    values = trees * depth

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], values)
                rows: list[bytes | None] = [None] * len(sets)
                short: list[bytes | None] = [None] * len(sets)
                for k, (i, sketch) in enumerate(zip(full, sketches(sig))):
                    rows[i], short[i] = sig[k].astype(">u2").tobytes(), sketch
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"),
                    "n": pa.array([len(s) for s in sets], pa.int64()), "name": pa.array(names, pa.binary()),
                    "labels": pa.array(rows, pa.binary()), "sketch": pa.array(short, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        one, "doc_id bigint, row_key bigint, n bigint, name binary, labels binary, sketch binary")


def _pairs_in_order(rows: DataFrame, least: int, prefix: int, region: int, ends: bool, held: int = HELD) -> DataFrame:
    """What sorted ``rows`` (``zone``, ``label``, ``id``, ``n``, ``part``, ``sketch``) give, by ``kind``:

    0: pairs ``a`` < ``b`` of different parts ``pa`` and ``pb``, but for those that their sketches rule out.
    1: with ``ends``, labels that may go on in another partition: its first and
       last run (``a`` id, ``b`` zone, ``pa`` part), or with ``region`` 0 its
       first and last label, under the number of the end they stand at.
    2: sets in regions too large for their labels (``a`` id, ``pa`` part).
    3: labels, as in 1, of runs of more than ``held`` labels; none of their pairs are in 0.
    """
    columns = ["kind", "a", "b", "pa", "pb", "label", "n", "sketch"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()

        def like(frame: pd.DataFrame, zone: int, start: bytes) -> np.ndarray:
            """Labels of a frame that are of the run (zone and prefix)."""
            return ((frame["zone"] == zone) & (frame["label"].str[:2 * prefix] == start)).to_numpy()

        def run_of(frame: pd.DataFrame, at: int) -> tuple[int, bytes]:
            return frame["zone"].iloc[at], frame["label"].iloc[at][:2 * prefix]

        def made(frame: pd.DataFrame) -> pd.DataFrame:
            labels = np.array([np.frombuffer(x, dtype=">u2") for x in frame["label"]])
            ids, n, part = (frame[c].to_numpy() for c in ("id", "n", "part"))
            rest: list[np.ndarray] = []
            i, j = neighbours(frame["zone"].to_numpy(), labels, part, prefix, region, rest=rest)
            fit = 100 * np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j])
            if region:  # beyond neighbours, half of a tree's values agree: with the prefix given, nearly sure from 80 per cent
                i, j = i[fit], j[fit]
                fit = (np.abs(i - j) == 1) | (2 * (labels[i] == labels[j]).sum(axis=1) >= labels.shape[1])
            i, j = i[fit], j[fit]
            if frame["sketch"].notna().all():
                short = np.array([np.frombuffer(x, dtype=np.uint8) for x in frame["sketch"]])
                fit = [np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64) for x, y in zip(
                    np.array_split(i, len(i) // PAIRS + 1), np.array_split(j, len(j) // PAIRS + 1))]
                fit = np.concatenate(fit) <= most_bits(least, 8 * short.shape[1])
                i, j = i[fit], j[fit]
            i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
            out = pd.DataFrame({"a": ids[i], "b": ids[j], "pa": part[i], "pb": part[j]}).drop_duplicates()
            out = out.assign(kind=0, label=None, n=None, sketch=None)
            if rest:
                at = np.concatenate(rest)
                out = pd.concat([out, pd.DataFrame({"kind": 2, "a": ids[at], "b": ids[at], "pa": part[at],
                                                    "pb": part[at], "label": None, "n": None, "sketch": None})],
                                ignore_index=True)
            return out[columns].astype({"kind": "int32"})

        def handed(frame: pd.DataFrame, kind: int, at: int = 0) -> pd.DataFrame:
            return pd.DataFrame({"kind": kind, "a": frame["id"], "b": at * 256 + frame["zone"], "pa": frame["part"],
                                 "pb": 0, "label": frame["label"], "n": frame["n"], "sketch": frame["sketch"]}
                                ).astype({"kind": "int32"})

        def adjacent() -> Iterator[pd.DataFrame]:
            last: pd.DataFrame | None = None
            for frame in batches:
                if not len(frame):
                    continue
                if last is not None:
                    frame = pd.concat([last, frame], ignore_index=True)
                elif ends:
                    yield handed(frame.iloc[:1], 1, number - 1)
                yield made(frame)
                last = frame.iloc[len(frame) - 1:]
            if last is not None and ends:
                yield handed(last, 1, number)

        def regions() -> Iterator[pd.DataFrame]:
            kept: pd.DataFrame | None = None         # the open run
            long: tuple[int, bytes] | None = None    # or what it is, if it is too long to keep
            first = ends
            for frame in batches:
                if long is not None and len(frame):
                    more = int(like(frame, *long).sum())
                    if more:
                        yield handed(frame.iloc[:more], 3)
                        frame = frame.iloc[more:]
                    if len(frame):
                        long, first = None, False
                if not len(frame):
                    continue
                if kept is not None:
                    frame = pd.concat([kept, frame], ignore_index=True)
                cut = len(frame) - int(like(frame, *run_of(frame, -1)).sum())
                if cut:
                    done = frame.iloc[:cut]
                    if first:
                        head = int(like(done, *run_of(done, 0)).sum())
                        yield handed(done.iloc[:head], 1)
                        done, first = done.iloc[head:], False
                    if len(done):
                        yield made(done)
                kept = frame.iloc[cut:]
                if len(kept) > held:
                    yield handed(kept, 3)
                    kept, long = None, run_of(kept, 0)
            if kept is not None:
                yield handed(kept, 1) if ends else made(kept)

        yield from regions() if region else adjacent()

    return rows.mapInPandas(scan, "kind int, a bigint, b bigint, pa bigint, pb bigint, label binary, n bigint, "
                                 "sketch binary")


def candidates(sets: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, prefix: int = PREFIX,
               region: int = REGION, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs ``a`` < ``b`` of ``sets`` (``id``, ``n``,
    ``labels``, ``part``, and ``sketch`` if there is one) of different parts ``pa`` and ``pb``; and the sets
    (``id``, ``part``) that the labels do not tell apart, or that stand in
    runs of more than ``held`` labels, whose pairs are for ``rarest_pairs``."""
    width = 2 * depth
    sketch = F.col("sketch") if "sketch" in sets.columns else F.lit(None).cast("binary").alias("sketch")
    rows = sets.select("id", "n", "part", sketch, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.substring("labels", t * width + 1, F.lit(width)))).alias("zone", "label"))
    rows = rows.select(F.col("zone").cast("long").alias("zone"), "label", "id", "n", "part", "sketch")
    order = ["zone", "label", "id"]
    found = stage_table(_pairs_in_order(
        rows.repartitionByRange(*order).sortWithinPartitions(*order), least, prefix, region, True, held), "found")

    def handed(df: DataFrame, kind: int) -> DataFrame:
        return df.filter(F.col("kind") == kind).select(
            F.col("b").alias("zone"), "label", F.col("a").alias("id"), "n", F.col("pa").alias("part"), "sketch",
            F.substring("label", 1, 2 * prefix).alias("start"))

    run = ["zone", "start"]
    # what meets at the end of a partition; a run that is long in one partition is long
    long = handed(found, 3).select(*run).distinct()
    ends = handed(found, 1)
    short = ends.join(long, run, "left_anti") if region else ends
    keys = run if region else ["zone"]
    across = stage_table(_pairs_in_order(short.repartition(*keys).sortWithinPartitions(*order).select(*order, "n", "part", "sketch"),
                                         least, prefix, region, False, held), "across")
    both = found.unionByName(across)
    pairs = both.filter("kind = 0").select("a", "b", "pa", "pb").distinct()
    left = both.filter("kind = 2").select(F.col("a").alias("id"), F.col("pa").alias("part"))
    # long runs of one part have nothing to meet
    whole = handed(both, 3).unionByName(ends.join(long, run, "left_semi"))
    mixed = whole.groupBy(*run).agg(F.min("part").alias("_x"), F.max("part").alias("_y")).filter("_x < _y").select(*run)
    left = left.unionByName(whole.join(mixed, run, "left_semi").select("id", "part"))
    return pairs, left.distinct()


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Per set, whether an odd number of its shingles fall on each of ``PARITY``
    places, as longs. What two sets share cancels out, so they differ in at
    most as many bits as there are shingles in one of them only."""
    place = np.concatenate([s & np.uint64(PARITY - 1) for s in sets]).astype(np.int64)
    place += np.repeat(np.arange(len(sets)) * PARITY, [len(s) for s in sets])
    odd = (np.bincount(place, minlength=len(sets) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").reshape(len(sets), -1)


def _named(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``id`` is in ``needed``, and a few others
    that fall on the same slots. Bitmaps of the slots, 4 MB at most, go to all
    tasks, so no text moves however many are needed."""
    slot = F.pmod(F.xxhash64("id"), F.lit(NAMED).cast("long"))
    bitmaps = needed.select(slot.alias("_slot")).groupBy(F.expr("shiftright(_slot, 15)").alias("_bitmap")).agg(
        F.expr("bitmap_construct_agg(_slot & 32767)").alias("_bits"))
    on = F.expr("shiftright(_slot, 15) = _bitmap AND "
                "shiftright(cast(conv(hex(substring(_bits, cast((_slot & 32767) div 8 + 1 AS int), 1)), 16, 10) AS int), "
                "cast(_slot & 7 AS int)) & 1 = 1")
    return texts.withColumn("_slot", slot).join(F.broadcast(bitmaps), on, "left_semi").drop("_slot")


def _shingles(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """``id``, ``shingles``, their number ``n`` and ``parity`` of the rows of
    ``docs`` named in ``needed`` (``id``), and of a few others (``_named``)."""
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                some = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(s) for s in some])
                parity = parities(some)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id"), "shingles": pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.concatenate(some).view(np.int64))),
                    "n": pa.array(np.diff(ends), pa.int64()), "parity": pa.ListArray.from_arrays(
                        pa.array(np.arange(len(some) + 1) * parity.shape[1], pa.int32()), pa.array(parity.ravel()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return stage_table(_named(texts, needed).mapInArrow(
        full, "id bigint, shingles array<bigint>, n bigint, parity array<bigint>"), "shingles")


def rarest_pairs(docs: DataFrame, left: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """All pairs of the sets in ``left`` (``id``, ``part``) of different
    parts that can be at or above the similarity, without chance: ``a`` <
    ``b``, ``pa`` and ``pb``.

    Each set's shingles are put in one order for all, rare ones first. Sets
    of x and y shingles with at least ``need`` = least (x + y) / (100 + least)
    in common have their first common shingle within the first x - need + 1
    and y - need + 1. The smaller set so needs few shingles; in a family of
    pages with a common body those are its own. How rare a shingle is comes
    from counts in a fixed number of slots: any common order is right, and
    clashes only make it less sharp. Where many sets share such shingles
    (pages filled from common alternatives), the pairs that meet are still
    many; a sketch of ``BITS`` bits goes along and rules out, inside the
    join, those that chance cannot bring so far apart.
    """
    left = stage_table(left.dropDuplicates(["id"]), "left_parts")
    shingles = _shingles(docs, left, words).select("id", "shingles")
    slot = F.col("s").bitwiseAND(F.lit(SLOTS - 1))
    seen = (shingles.select(F.explode("shingles").alias("s")).groupBy(slot.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n")).toPandas())
    often = np.zeros(SLOTS, dtype=np.uint32)
    often[seen["slot"].to_numpy(np.int64)] = np.minimum(seen["n"].to_numpy(np.int64), 2**32 - 1)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                sets = [x.values.to_numpy() for x in batch.column("shingles")]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                held = n - (least * n + 99) // 100 + 1
                short = n - (2 * least * n + 99 + least) // (100 + least) + 1
                first = [s[np.lexsort((s, often[s & (SLOTS - 1)]))[:k]] for s, k in zip(sets, held)]
                place = np.concatenate([np.arange(k) for k in held])
                each = pa.array(np.repeat(np.arange(len(sets)), held))
                bits = [np.frombuffer(x, "<i8") for x in sketches(signatures([x.view(np.uint64) for x in sets], BITS))]
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BITS // 64 + 1, BITS // 64), pa.int32()),
                                                  pa.array(np.concatenate(bits)))
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(np.concatenate(first)), "at": pa.array(place),
                    "id": batch.column("id").take(each), "part": batch.column("part").take(each),
                    "n": pa.array(np.repeat(n, held)), "short": pa.array(place < np.repeat(short, held)),
                    "sketch": sketch.take(each)})

    rows = stage_table(shingles.join(left, "id").mapInArrow(
        rare, "token bigint, at bigint, id bigint, part bigint, n bigint, short boolean, sketch array<bigint>"), "rarest")
    # a part's sets need not meet each other: of the part most frequent at a shingle only the others are met
    most = (rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("_n"), F.max("short").alias("_short"))
            .groupBy("token").agg(F.max_by("part", F.struct("_n", "part")).alias("most"),
                                  F.count(F.lit(1)).alias("_parts"), F.max("_short").alias("_short"))
            .filter("_parts > 1 AND _short").select("token", "most"))
    rows = stage_table(rows.join(most, "token"), "meeting")

    differ = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(BITS // 64))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        need = f"(({least} * (x.n + y.n) + {99 + least}) div {100 + least})"
        return x.alias("x").join(y.alias("y"), F.expr(
            f"x.token = y.token AND x.part <> y.part AND (x.n < y.n OR (x.n = y.n AND x.id < y.id)) "
            f"AND 100 * x.n >= {least} * y.n AND x.at <= x.n - {need} AND y.at <= y.n - {need} "
            f"AND {differ} <= {most_bits(least, BITS)}")).selectExpr(
            "least(x.id, y.id) AS a", "greatest(x.id, y.id) AS b",
            "IF(x.id < y.id, x.part, y.part) AS pa", "IF(x.id < y.id, y.part, x.part) AS pb")

    return met(rows.filter("short AND part <> most"), rows).unionByName(
        met(rows.filter("short AND part = most"), rows.filter("part <> most"))).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The ``pairs`` (``a`` and ``b``) that are at or above the similarity on
    the full sets of the whole texts in ``docs``. Sketches have ruled out
    what is far from it. Sets of x and y shingles at the similarity have at
    most (100 - least) (x + y) / (100 + least) that are in one of them only; pairs whose parities
    differ in more bits are not links, for certain, and their sets, many
    times longer, are not moved."""
    pairs = stage_table(pairs, "pairs")
    needed = stage_table(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
                         .distinct(), "needed")

    shingles = _shingles(docs, needed, words)
    differ = " + ".join(f"bit_count(_p[{k}] ^ _q[{k}])" for k in range(PARITY // 64))
    columns = pairs.columns
    pairs = stage_table(
        pairs.join(shingles.select(F.col("id").alias("a"), F.col("n").alias("_x"), F.col("parity").alias("_p")), "a")
        .join(shingles.select(F.col("id").alias("b"), F.col("n").alias("_y"), F.col("parity").alias("_q")), "b")
        .filter(F.expr(f"{100 + least} * ({differ}) <= {100 - least} * (_x + _y)")).select(*columns).distinct(), "close")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    shingles = shingles.select("id", "shingles").join(ids, "id", "left_semi")
    # in the JVM, row by row: Arrow batches of two whole sets a row could be large
    both = F.size(F.array_intersect("_x", "_y"))
    return stage_table(
        pairs.join(shingles.select(F.col("id").alias("a"), F.col("shingles").alias("_x")), "a")
        .join(shingles.select(F.col("id").alias("b"), F.col("shingles").alias("_y")), "b")
        .filter(100 * both >= least * (F.size("_x") + F.size("_y") - both)).drop("_x", "_y"), "links")


def _joined(parts: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``parts`` with the ``part`` that ``links`` between parts (``a``, ``b``) lead to."""
    found = components(links)
    return stage_table(parts.join(found, parts["part"] == found["node"], "left").select(
        *[c for c in parts.columns if c != "part"], F.coalesce("label", "part").alias("part")), name)


def near_groups(docs: DataFrame, words: int = WORDS, least: int = LEAST, trees: int = TREES, depth: int = DEPTH,
                prefix: int = PREFIX, region: int = REGION, held: int = HELD) -> DataFrame:
    """Groups of near copies.

    Returns one row per row of ``docs``: ``doc_id``, ``row_key``,
    ``n_shingles``, ``component_id`` (the smallest doc_id reachable over
    links of at least ``least`` per cent, itself included) and ``kept``
    (doc_id = component_id). Texts without words, and null ones, are linked
    with nothing. Rows without doc_id name no component: they get a null one
    and are kept. A doc_id should name one text; rows of one doc_id with
    several go by their own text each, and sets named by the same doc_id are
    one group. An empty table gives an empty result; other columns are
    ignored.

    Neighbours in the first sorted orders are confirmed first. All orders and
    their regions then give pairs between different components only, so a
    large group of near copies is joined by its neighbours and costs no pairs
    within it.
    """
    rows = stage_table(_sets(docs, words, trees, depth), "sets")
    # equal sets are one; their smallest doc_id stands for them
    sets = stage_table(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "name").agg(
        F.min("doc_id").alias("id"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch")), "classes")
    first, _ = candidates(sets.withColumn("part", F.col("id")), min(FIRST_TREES, trees), depth, least, prefix, 0)
    tried = stage_table(first, "tried")
    links = confirmed(docs, tried.select("a", "b"), words, least)
    parts = _joined(sets.withColumn("part", F.col("id")), links, "parts")
    rest, left = candidates(parts, trees, depth, least, prefix, region, held)
    rest = stage_table(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    left = stage_table(left, "left")
    more = confirmed(docs, rest, words, least)
    # labels and sketches have done their work
    parts = _joined(parts.drop("labels", "sketch"), more.select(F.col("pa").alias("a"), F.col("pb").alias("b")), "more_parts")
    if not left.isEmpty():
        # most of what is left has been joined by now, and need not meet again
        known = tried.select("a", "b").unionByName(rest.select("a", "b"))
        last = rarest_pairs(docs, left.select("id").join(parts.select("id", "part"), "id"), words, least)
        last = confirmed(docs, last.join(known, ["a", "b"], "left_anti"), words, least)
        parts = _joined(parts, last.select(F.col("pa").alias("a"), F.col("pb").alias("b")), "last_parts")
    classes = parts.select(F.col("n").alias("_n"), F.col("name").alias("_name"), F.col("part").alias("_component"))
    on = (rows["n"] == classes["_n"]) & (rows["name"] == classes["_name"]) & rows["doc_id"].isNotNull()
    component = F.coalesce("_component", "doc_id")
    return rows.drop("labels", "sketch").join(classes, on, "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(groups: DataFrame) -> DataFrame:
    """Decisions for ``common.keep_rows``: of each group of ``near_groups``
    one row of the document that names it; rows without doc_id all stay."""
    first = groups.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.min("row_key").alias("_first"))
    return groups.join(first, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "row_key", (F.col("kept") & (F.col("doc_id").isNull() | (F.col("row_key") == F.col("_first")))
                              ).cast("int").alias("copies"))


def without_near_copies(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, unchanged, one of each group of near copies.

    The document with the smallest doc_id of a group stays; texts without
    words are in no group and stay. Where a doc_id is null or names several
    rows, rows are numbered first (in the order of doc_id and content) and go
    by their numbers, so unlike texts under one doc_id both stay, and of rows
    that repeat each other one does. Whole texts are compared, however long.
    An empty table gives an empty result.
    """
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1")
    if unclear.isEmpty():
        groups = stage_table(near_groups(docs, words, least), "near_groups")
        return keep_rows(docs, one_of_each(groups), once=True)
    rows, columns = apart(docs)
    rows = sorted_rank(rows.withColumn("_content", row_key(rows)),
                       [F.col("doc_id").asc_nulls_last(), F.col("_content")], "_number")
    groups = near_groups(rows.select(F.col("_number").alias("doc_id"), "text"), words, least)
    kept = stage_table(groups.filter("kept").select(F.col("doc_id").alias("_kept")), "near_groups")
    return rows.join(kept, F.col("_number") == F.col("_kept"), "left_semi").select(*columns)

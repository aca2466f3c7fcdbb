"""Hard negatives by rotated one-bit codes.

Every vector x is turned by one random rotation, and of the turned vector y
the signs are kept as bits, with x's length and its alignment a: the cosine
between y and its sign vector b (of length 1). For a query turned the same
way, the part of y along b gives the estimate |x| a <b, q>, where <b, q> comes
from popcounts of the bits with bit planes of the query's whole-number code.
The rest of y is orthogonal to b and |x| sqrt(1 - a^2) long, so by
Cauchy-Schwarz it adds at most |x| sqrt(1 - a^2) sqrt(|q|^2 - <b, q>^2) either
way: an interval that holds the inner product for sure. Rows whose interval
misses what is asked for go; the rest get their exact integer product. The
rows with the best estimates are scored first, and the k-th of them then
narrows what is asked for.

Rows are dealt to shards by label, large labels to several; an anchor looks
for positives in the shards of its label only, and for negatives in all but
those that hold nothing else. A shard's rows are sorted before the anchors
that come to it, so a task holds one shard and streams any number of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import stage_table
from mensura.llm.vectors import SCALE, integer_codes, matrix, products

POSITIVES = 5
NEGATIVES = 3
#: A negative scores between so many per cent of the positive's score.
LEAST, MOST = 50, 95
SHARD_ROWS = 4096
#: Anchors estimated against a shard at a time.
CHUNK = 32
#: Bits of a query's code.
PLANES = 6
#: Room for rounding in the intervals, relative to |x| |q|.
ROUNDING = 1e-9


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 12) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def one_bit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits (rows x 64-bit words), lengths and alignments of integer rows."""
    n, dim = vectors.shape
    x = vectors.astype(np.float64)
    turned = x @ rotation(dim).T
    words = -(-dim // 64)
    bits = np.zeros((n, words * 64), dtype=np.uint8)
    bits[:, :dim] = turned >= 0
    packed = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(n, words)
    length = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        align = np.abs(turned).sum(axis=1) / (np.sqrt(max(dim, 1)) * length)
    return packed, length, np.where(length > 0, np.minimum(align, 1.0), 0.0)


class Shard:
    """Rows of one shard, and the intervals of their products with queries."""

    def __init__(self, frame: pd.DataFrame):
        self.dim = int(frame["dim"].iloc[0])
        self.rows, self.ids, self.labels = (frame[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.codes = matrix(frame["code"].tolist(), self.dim)
        words = -(-self.dim // 64)
        self.bits = np.frombuffer(b"".join(frame["bits"]), dtype="<u8").reshape(len(frame), words)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.length, self.align = frame["length"].to_numpy(), frame["align"].to_numpy()
        self.rest = np.sqrt(np.maximum(1.0 - self.align**2, 0.0))

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, lower and upper end of every product: queries x rows."""
        turned = queries.astype(np.float64) @ rotation(self.dim).T
        size = np.sqrt((turned**2).sum(axis=1))
        half = 1 << (PLANES - 1)
        step = np.maximum(np.abs(turned).max(axis=1, initial=0.0), 1e-300) / (half - 1)
        whole = np.rint(turned / step[:, None]).astype(np.int64)
        missed = np.sqrt(((turned - whole * step[:, None]) ** 2).sum(axis=1))
        shifted = np.zeros((len(queries), self.bits.shape[1] * 64), dtype=np.uint8)
        shifted[:, :self.dim] = whole + half
        total = np.zeros((len(queries), len(self.rows)), dtype=np.int64)
        for plane in range(PLANES):
            words = np.packbits((shifted >> plane) & 1, axis=1, bitorder="little").view("<u8")
            for word in range(self.bits.shape[1]):
                met = np.bitwise_count(self.bits[None, :, word] & words[:, word, None])
                total += met.astype(np.int64) << plane
        signed = 2 * (total - half * self.ones) - whole.sum(axis=1)[:, None]
        along = signed * (step / np.sqrt(max(self.dim, 1)))[:, None]      # <b, q>, up to ``missed``
        estimate = self.length * self.align * along
        across = np.maximum(np.abs(along) - missed[:, None], 0.0)
        across = np.sqrt(np.maximum(size[:, None] ** 2 - across**2, 0.0))
        room = self.length * (self.align * missed[:, None] + self.rest * across + ROUNDING * size[:, None])
        return estimate, estimate - room, estimate + room

    def best(self, query: np.ndarray, scores: dict, ends: tuple, allowed: np.ndarray, k: int,
             lo: int | None, hi: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest products within [lo, hi] among the rows
        ``allowed``: places and products, ties to the smaller id.
        ``scores`` keeps what was calculated for this query."""
        estimate, lower, upper = ends
        if lo is not None:
            allowed = allowed & (upper >= lo)
        if hi is not None:
            allowed = allowed & (lower <= hi)
        at = np.flatnonzero(allowed)

        def exact(place: np.ndarray) -> np.ndarray:
            if "all" not in scores and 4 * len(place) > len(self.rows):
                scores["all"] = products(self.codes, query)
            return scores["all"][place] if "all" in scores else products(self.codes[place], query)

        def inside(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            score = exact(place)
            fit = np.ones(len(place), dtype=bool)
            if lo is not None:
                fit &= (score >= lo).astype(bool)
            if hi is not None:
                fit &= (score <= hi).astype(bool)
            return place[fit], score[fit]

        if len(at) > 8 * k:
            guess = estimate[at]
            if hi is not None:
                guess = np.where(guess <= hi, guess, -np.inf)
            _, tried = inside(at[np.argpartition(-guess, 4 * k)[:4 * k]])
            if len(tried) >= k:
                at = at[upper[at] >= float(np.sort(tried)[-k])]
        place, score = inside(at)
        order = np.lexsort((self.rows[place], self.ids[place], -score))[:k]
        return place[order], score[order]


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``bits``, ``length`` and ``align``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                bits, length, align = one_bit(matrix(part.column("code"), int(dim)))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names} | {
                    "bits": pa.array([b.tobytes() for b in bits], pa.binary()),
                    "length": pa.array(length), "align": pa.array(align)})

    return rows.mapInArrow(add, "row bigint, vec_id bigint, label bigint, dim int, code binary, bits binary, "
                                "length double, align double")


def _dealt(rows: DataFrame, shard_rows: int) -> DataFrame:
    """``rows`` with ``shard``; the shards of their label from ``first`` on,
    ``pure`` of them with no other label in them (0 for a shared shard); and
    the shards ``low`` to ``high`` - 1 of their length.

    What comes to the driver is one count per label of more than
    ``shard_rows`` rows (so at most a row in ``shard_rows``), and per length.
    """
    spark = rows.sparkSession
    labels = stage_table(rows.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")), "label_counts")
    large = labels.filter(F.col("n") > shard_rows).orderBy("dim", "label").collect()
    small = {r["dim"]: r["n"] for r in labels.groupBy("dim").agg(
        F.sum(F.when(F.col("n") <= shard_rows, F.col("n")).otherwise(0)).alias("n")).collect()}
    next_shard, of_label, of_dim = 0, [], []
    for dim in sorted(small):
        low = next_shard
        for r in large:
            if r["dim"] == dim:
                pure = -(-r["n"] // shard_rows)
                of_label.append((dim, r["label"], next_shard, pure))
                next_shard += pure
        shared = max(1, -(-small[dim] // shard_rows))
        of_dim.append((dim, low, next_shard, shared, next_shard + shared))
        next_shard += shared
    of_label = spark.createDataFrame(of_label, "dim int, label bigint, _first int, _pure int")
    of_dim = spark.createDataFrame(of_dim, "dim int, low int, _shared_from int, _shared int, high int")
    own = F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_pure"))
    shared = F.col("_shared_from") + F.pmod(F.xxhash64("label"), F.col("_shared"))
    return (rows.join(of_dim, "dim").join(of_label, ["dim", "label"], "left")
            .withColumn("shard", F.coalesce(own, shared).cast("int"))
            .withColumn("first", F.coalesce(F.col("_first"), F.col("shard")))
            .withColumn("pure", F.coalesce(F.col("_pure"), F.lit(0)))
            .drop("_first", "_pure", "_shared_from", "_shared"))


_HELD = ["shard", "kind", "row", "vec_id", "label", "dim", "code", "bits", "length", "align", "asked"]
_FOUND = "row bigint, about int, place bigint, vec_id bigint, score bigint"


def _meet(held: DataFrame, asked: DataFrame, k: int, same_label: bool) -> DataFrame:
    """What each of ``asked`` (an anchor and the ``shard`` it goes to, with
    the windows ``asked``: [lo, hi], null for open) finds there: per window
    (``about``, its number) the ``k`` best rows of its own label
    (``same_label``) or of others; ``place`` is the row found."""
    rows = held.withColumn("kind", F.lit(0)).withColumn("asked", F.lit(None).cast("array<array<bigint>>"))
    queries = (asked.withColumn("kind", F.lit(1)).withColumn("bits", F.lit(None).cast("binary"))
               .withColumn("length", F.lit(0.0)).withColumn("align", F.lit(0.0)))
    together = rows.select(*_HELD).unionByName(queries.select(*_HELD)).repartition("shard").sortWithinPartitions(
        "shard", "kind", "row")

    def answer(shard: Shard, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for at in range(0, len(frame), CHUNK):
            part = frame.iloc[at:at + CHUNK]
            codes = matrix(part["code"].tolist(), shard.dim)
            ends = shard.intervals(codes)
            out = []
            for i, (row, label, windows) in enumerate(zip(part["row"], part["label"], part["asked"])):
                allowed = (shard.labels == label) if same_label else (shard.labels != label)
                allowed &= shard.rows != row
                scores: dict = {}
                for about, (lo, hi) in enumerate(windows):
                    lo, hi = (None if x is None or x != x else int(x) for x in (lo, hi))
                    place, score = shard.best(codes[i], scores, tuple(e[i] for e in ends), allowed, k, lo, hi)
                    out += zip([row] * len(place), [about] * len(place), shard.rows[place].tolist(),
                               shard.ids[place].tolist(), map(int, score))
            yield pd.DataFrame(out, columns=["row", "about", "place", "vec_id", "score"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, waiting, shard = None, [], None
        for batch in batches:
            for (s, kind), frame in batch.groupby(["shard", "kind"], sort=True):
                if s != number:
                    number, waiting, shard = s, [], None
                if kind == 0:
                    waiting.append(frame)
                elif waiting or shard is not None:
                    if shard is None:
                        shard, waiting = Shard(pd.concat(waiting, ignore_index=True)), []
                    yield from answer(shard, frame)

    return together.mapInPandas(scan, _FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` (on ``vec_id``) picks.

    ``vectors``: ``vec_id``, ``embedding``, ``label`` (whole numbers). Scores
    are inner products of floor(``scale`` * x), in 64 bits; higher ones come
    first, ties to the smaller ``vec_id``. An anchor's positives are its first
    ``positives`` other rows of its label. Per anchor and positive come the
    first ``negatives`` rows of other labels that score from ``least`` to
    ``most`` per cent of the positive: ``anchor_id``, ``positive_id``,
    ``rank`` (from 1), ``negative_id``, ``positive_score``,
    ``negative_score``.

    Rows with a null ``vec_id`` or label, or whose vector is null or holds
    null or non-finite entries, take no part; vectors are compared with those
    of their length. Repeated rows are rows of their own (only the anchor's
    own row is not its positive). Other columns are ignored; an empty table
    gives an empty result. Nothing is approximate: the intervals only save
    products.
    """
    rows = integer_codes(vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"), "embedding"), ["row", "vec_id", "label"], scale)
    rows = stage_table(_coded(rows), "one_bit")
    held = stage_table(_dealt(rows, shard_rows), "shards")
    anchors = held.filter(F.coalesce(is_anchor, F.lit(False)))

    open_ = F.array(F.array(F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    own = F.sequence(F.col("first"), F.col("first") + F.greatest(F.col("pure"), F.lit(1)) - 1)
    found = _meet(held, anchors.withColumn("shard", F.explode(own)).withColumn("asked", open_), positives, True)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "place"))
    # a positive's window of scores; empty for those below 0
    found = stage_table(found.withColumn("_rank", rank).filter(F.col("_rank") <= positives), "positives")
    lo, hi = F.expr(f"-((-score * {least}L - pmod(-score * {least}L, 100L)) div 100L)"), F.expr(
        f"(score * {most}L - pmod(score * {most}L, 100L)) div 100L")
    window = F.struct(F.col("_rank").alias("rank"), lo.alias("lo"), hi.alias("hi"), F.col("vec_id").alias("id"),
                      F.col("score").alias("score"))
    windows = found.groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("_w")).withColumn(
        "_w", F.filter("_w", lambda w: w["lo"] <= w["hi"])).filter(F.size("_w") > 0)
    windows = stage_table(windows, "windows")

    asked = anchors.join(windows, "row").withColumn("asked", F.transform("_w", lambda w: F.array(w["lo"], w["hi"])))
    others = F.filter(F.sequence(F.col("low"), F.col("high") - 1), lambda s: (F.col("pure") == 0) | (
        s < F.col("first")) | (s >= F.col("first") + F.col("pure")))
    met = _meet(held, asked.withColumn("shard", F.explode(others)), negatives, False)
    rank = F.row_number().over(Window.partitionBy("row", "about").orderBy(F.col("score").desc(), "vec_id", "place"))
    met = met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    positive = F.element_at("_w", F.col("about") + 1)
    named = anchors.select("row", F.col("vec_id").alias("anchor_id")).join(windows, "row")
    return met.join(named, "row").select(
        "anchor_id", positive["id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))

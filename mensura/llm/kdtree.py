"""Exact top-k inner products by KD-trees per shard.

Space is cut into at most ``CELLS`` cells by the median splits of a bounded
sample (the splits only place vectors; every vector is in a cell, and boxes
are those of all its vectors), and the rows of a cell are dealt to shards.
Each shard holds a KD-tree: nodes are split at the median of their widest
component, and carry the tight box of their vectors. The inner product of a
query with anything in a box is at most the sum of its components times the
box's upper or lower ends, by sign. A query walks a tree best bound first and
stops when the best bound left is below its k-th score. It starts in a shard
of its own cell; the k-th score found there goes with it, and only shards of
cells whose bound reaches it get the query at all. A shard's vectors are
sorted before the queries that come to it, so the table moves once a pass and
a task holds one shard, whatever the number of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import row_key, stage_table

K = 5
SCALE = 256
SHARD_ROWS = 2048
LEAF_ROWS = 96
#: Cells that space is cut into at most (per length of vectors).
CELLS = 4096
#: Numbers (rows x components) of the sample that the cells are cut by, about.
SAMPLE = 1 << 22
#: Queries held against a shard, or against the cells, at a time.
CHUNK = 256
_WHOLE = 1 << 53


def product(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; Python integers where 64 bits may not do."""
    if vectors.size and query.size:
        most = float(np.abs(vectors).max()) * float(np.abs(query).max()) * vectors.shape[-1]
        if most < _WHOLE:
            return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        return vectors.astype(object) @ query.astype(object)
    return np.zeros(vectors.shape[:1] + query.shape[1:], dtype=np.int64)


class Tree:
    """KD-tree over integer vectors with their row numbers and ids."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(rows))
        lo, hi, kids, spans, least = [], [], [], [], []

        def grow(a: int, b: int) -> int:
            v = vectors[order[a:b]]
            node = len(lo)
            lo.append(v.min(axis=0))
            hi.append(v.max(axis=0))
            least.append(int(ids[order[a:b]].min()))
            kids.append((-1, -1))
            spans.append((a, b))
            if b - a > leaf_rows and v.shape[1]:
                wide = int(np.argmax(hi[node].astype(float) - lo[node].astype(float)))
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(v[:, wide], mid)]
                kids[node] = (grow(a, a + mid), grow(a + mid, b))
            return node

        grow(0, len(rows))
        self.lo, self.hi, self.kids, self.spans, self.least = np.array(lo), np.array(hi), kids, spans, least
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Most that any vector of a node can score: nodes x queries."""
        return (product(self.hi, np.maximum(queries, 0).T) + product(self.lo, np.minimum(queries, 0).T))

    def search(self, row: int, query: np.ndarray, bounds: list[int], k: int, start: tuple[int, int] | None
               ) -> list[tuple[int, int]]:
        """The best ``k`` (score, -id) of the tree but for ``row``; of those
        not better than ``start``, the k-th elsewhere, any may be missing."""
        best: list[tuple[int, int]] = []  # a heap, the worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            worst = best[0] if len(best) == k else None
            if start is not None and (worst is None or start > worst):
                worst = start
            if worst is not None and -bound < worst[0]:
                break
            if worst is not None and (-bound, -self.least[node]) < worst:
                continue  # as good at most, and only with larger ids
            a, b = self.spans[node]
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            scores = product(self.vectors[a:b], query)
            if worst is not None:
                take = np.flatnonzero(scores >= worst[0])
            else:
                take = np.arange(b - a)
            for i in take.tolist():
                if self.rows[a + i] != row:
                    found = (int(scores[i]), -int(self.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
        return sorted(best, reverse=True)


def _codes(frame: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(frame["code"]), dtype="<i8").reshape(len(frame), dim)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row``, ``vec_id``, ``dim`` and ``code`` (64-bit integers) of the
    vectors that take part: not null, without null, infinite or NaN
    components, and with a ``vec_id``."""
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.clip(np.floor(flat * scale), -2.0**62, 2.0**62).astype("<i8").tobytes()
            at = (x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py()) * 8
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "vec_id": batch.column("vec_id"),
                "dim": pa.array(np.diff(at) // 8, pa.int32()),
                "code": pa.array([whole[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())})

    def fine(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    x = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                       & F.forall("embedding", fine))
    return x.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("embedding").cast("array<double>").alias("embedding"),
                    ).mapInArrow(codes, "row bigint, vec_id bigint, dim int, code binary")


class Cells:
    """Median splits of a sample of integer vectors into ``count`` cells."""

    def __init__(self, sample: np.ndarray, count: int):
        self.at: list[tuple[int, int, int, int]] = []  # component, split, node of <= and of >
        self.count = 0

        def cut(v: np.ndarray, cells: int) -> int:
            """A node's number; of a cell c, -1 - c."""
            if cells > 1 and len(v) > 1 and v.shape[1]:
                wide = int(np.argmax(v.max(axis=0).astype(float) - v.min(axis=0).astype(float)))
                split = int(np.sort(v[:, wide])[(len(v) - 1) // 2])
                low = v[:, wide] <= split
                if low.all() and (v[:, wide] < split).any():
                    split = int(v[v[:, wide] < split, wide].max())
                    low = v[:, wide] <= split
                if not low.all():
                    node = len(self.at)
                    self.at.append((wide, split, 0, 0))
                    self.at[node] = (wide, split, cut(v[low], cells // 2), cut(v[~low], cells - cells // 2))
                    return node
            self.count += 1
            return -self.count

        self.root = cut(sample, count)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.empty(len(vectors), dtype=np.int32)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                wide, split, low, high = self.at[node]
                below = vectors[rows, wide] <= split
                todo += [(low, rows[below]), (high, rows[~below])]
        return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by length of their vectors, with these as a matrix."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield dim, part, np.frombuffer(b"".join(part.column("code").to_pylist()), dtype="<i8").reshape(
            part.num_rows, dim)


def _cut(rows: DataFrame, shard_rows: int, cells: int) -> dict[int, Cells]:
    """The cells per length of vectors: about one per ``shard_rows`` rows, at
    most ``cells``. To the driver come counts per length and samples of about
    ``SAMPLE`` numbers; what is sampled changes the cost, not the result."""
    out = {}
    for dim, n in rows.groupBy("dim").agg(F.count(F.lit(1))).collect():
        count = min(cells, -(-n // shard_rows))
        sample = np.empty((0, dim), dtype=np.int64)
        if count > 1:
            most = max(SAMPLE // max(dim, 1), 1)
            step = -(-n // most)
            codes = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("row", F.lit(8)), F.lit(step)) == 0)).select(
                "code").limit(2 * most).collect()
            sample = np.frombuffer(b"".join(bytes(r["code"]) for r in codes), dtype="<i8").reshape(len(codes), dim)
        out[dim] = Cells(sample, count)
    return out


def _placed(rows: DataFrame, cells: Mapping[int, Cells]) -> DataFrame:
    """``rows`` with their ``cell``."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, codes in _by_dim(batch):
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names} | {
                    "cell": pa.array(cells[dim].of(codes), pa.int32())})

    return rows.mapInArrow(place, "row bigint, vec_id bigint, dim int, code binary, cell int")


def _boxes(placed: DataFrame) -> DataFrame:
    """``dim``, ``cell``, ``n`` and the tight box (``lo``, ``hi``) of each cell:
    per task first, then together."""
    schema = "dim int, cell int, n bigint, lo binary, hi binary"

    def ends(dim: int, cell: int, n: int, lo: np.ndarray, hi: np.ndarray) -> tuple:
        return dim, cell, n, lo.astype("<i8").tobytes(), hi.astype("<i8").tobytes()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for dim, part, codes in _by_dim(batch):
                of = part.column("cell").to_numpy()
                for cell in np.unique(of).tolist():
                    v = codes[of == cell]
                    n, lo, hi = held.get((dim, cell), (0, v[0], v[0]))
                    held[dim, cell] = (n + len(v), np.minimum(lo, v.min(axis=0)), np.maximum(hi, v.max(axis=0)))
        if held:
            dims, of, n, lo, hi = zip(*[ends(*key, *box) for key, box in held.items()])
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(of, pa.int32()),
                                              pa.array(n, pa.int64()), pa.array(lo, pa.binary()),
                                              pa.array(hi, pa.binary())], names=["dim", "cell", "n", "lo", "hi"])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(group["dim"].iloc[0]), int(group["cell"].iloc[0])
        lo, hi = (np.frombuffer(b"".join(group[c]), dtype="<i8").reshape(len(group), dim) for c in ("lo", "hi"))
        return pd.DataFrame([ends(dim, cell, int(group["n"].sum()), lo.min(axis=0), hi.max(axis=0))],
                            columns=["dim", "cell", "n", "lo", "hi"])

    return placed.mapInArrow(partial, schema).groupBy("dim", "cell").applyInPandas(whole, schema)


def _reached(queries: DataFrame, boxes: Mapping[int, tuple]) -> DataFrame:
    """``queries`` with ``cells``: those that may hold a score that counts,
    i.e. whose bound is not below the k-th score so far (``_score``)."""
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                for dim, part, codes in _by_dim(whole.slice(at, CHUNK)):
                    cells, lo, hi = boxes[dim]
                    bound = product(hi, np.maximum(codes, 0).T) + product(lo, np.minimum(codes, 0).T)
                    found = [cells if s is None else cells[(bound[:, i] >= s).astype(bool)]
                             for i, s in enumerate(part.column("_score").to_pylist())]
                    yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names} | {
                        "cells": pa.array([f.tolist() for f in found], pa.list_(pa.int32()))})

    names = "row bigint, vec_id bigint, dim int, code binary, home bigint, _score bigint, _minus bigint"
    return queries.mapInArrow(reach, names + ", cells array<int>")


_HELD = ["shard", "kind", "row", "vec_id", "dim", "code", "_score", "_minus"]


def _meet(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best ``k`` that each of ``asked`` (a query and the ``shard`` it goes
    to, with its k-th score and id so far) finds there: ``row``, ``vec_id``,
    ``score``."""
    none = F.lit(None).cast("bigint")
    rows = held.withColumns({"kind": F.lit(0), "_score": none, "_minus": none}).select(*_HELD)
    together = rows.unionByName(asked.withColumn("kind", F.lit(1)).select(*_HELD)).repartition(
        "shard").sortWithinPartitions("shard", "kind", "row")

    def answer(tree: Tree, frame: pd.DataFrame, dim: int) -> Iterator[pd.DataFrame]:
        for at in range(0, len(frame), CHUNK):
            part = frame.iloc[at:at + CHUNK]
            codes = _codes(part, dim)
            bounds = tree.bounds(codes)
            out = []
            for i, (row, score, minus) in enumerate(zip(part["row"], part["_score"].astype("Int64"),
                                                        part["_minus"].astype("Int64"))):
                start = None if pd.isna(score) else (int(score), int(minus))
                out += [(row, -v, s) for s, v in tree.search(row, codes[i], bounds[:, i].tolist(), k, start)]
            yield pd.DataFrame(out, columns=["row", "vec_id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, tree = None, [], None
        for batch in batches:
            frame = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            for (shard, kind), part in frame.groupby(["shard", "kind"], sort=True):
                if shard != number:
                    number, waiting, tree = shard, [], None
                if kind == 0:
                    waiting.append(part)
                    continue
                dim = int(part["dim"].iloc[0])
                if tree is None:
                    if not waiting:
                        continue
                    own = pd.concat(waiting, ignore_index=True)
                    tree, waiting = Tree(own["row"].to_numpy(np.int64), own["vec_id"].to_numpy(np.int64),
                                         _codes(own, dim)), []
                for found in answer(tree, part, dim):
                    yield pa.RecordBatch.from_pydict({c: pa.array(found[c].tolist(), pa.int64()) for c in found})

    return together.mapInArrow(scan, "row bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
          cells: int = CELLS) -> DataFrame:
    """The ``k`` best scores of each query row against all other rows.

    ``vectors``: ``vec_id`` and ``embedding``; components count as
    floor(``scale`` * x). ``is_query`` picks the queries by ``vec_id``.
    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``, ties to
    the smaller vec_id. Repeated rows are rows of their own: only the query's
    own row is left out. Vectors of another length are not compared. Fewer
    candidates give fewer rows; an empty table gives none. Scores must fit
    in 64 bits.

    The answer is exact: a query meets every shard of every cell that its
    bounds do not rule out. To the driver come one box per cell (``cells`` at
    most per length of vectors) and the sample of ``_cut``.
    """
    spark = vectors.sparkSession
    rows = stage_table(quantised(vectors, scale), "codes")
    placed = stage_table(_placed(rows, _cut(rows, shard_rows, cells)), "cells")
    found_boxes = _boxes(placed).collect()
    boxes, shards, first = {}, [], 0
    for dim in sorted({b["dim"] for b in found_boxes}):
        own = sorted((b for b in found_boxes if b["dim"] == dim), key=lambda b: b["cell"])
        lo, hi = (np.frombuffer(b"".join(bytes(b[c]) for b in own), dtype="<i8").reshape(len(own), dim)
                  for c in ("lo", "hi"))
        boxes[dim] = (np.array([b["cell"] for b in own], dtype=np.int32), lo, hi)
        for b in own:
            shards.append((dim, b["cell"], first, -(-b["n"] // shard_rows)))
            first += shards[-1][-1]
    # bounded like the boxes: a row per cell
    of_cell = F.broadcast(spark.createDataFrame(shards, "dim int, cell int, _first bigint, _shards bigint"))
    held = placed.join(of_cell, ["dim", "cell"]).withColumn(
        "shard", F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_shards"))).drop("_first", "_shards", "cell")

    none = F.lit(None).cast("bigint")
    asked = held.filter(F.coalesce(is_query, F.lit(False)))
    first_found = stage_table(_meet(held, asked.withColumns({"_score": none, "_minus": none}), k), "home")
    best = F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("minus"))), asc=False)
    kth = first_found.groupBy("row").agg(F.try_element_at(best, F.lit(k)).alias("_kth"))  # k a query at most
    queries = asked.join(kth, "row", "left").select(
        "row", "vec_id", "dim", "code", F.col("shard").alias("home"), F.col("_kth.score").alias("_score"),
        F.col("_kth.minus").alias("_minus"))
    routes = _reached(queries, boxes).withColumn("cell", F.explode("cells")).join(of_cell, ["dim", "cell"])
    routes = routes.withColumn("shard", F.explode(F.sequence(
        F.col("_first"), F.col("_first") + F.col("_shards") - 1))).filter("shard <> home")
    found = first_found.unionByName(_meet(held, routes, k))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    named = asked.select("row", F.col("vec_id").alias("query_id"))
    return found.join(named, "row").select("query_id", "rank", "vec_id", "score")

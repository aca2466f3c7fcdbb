"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring. A document's key hashes to a place on
the ring and belongs to the next point clockwise; if that point's shard is
full, it goes on clockwise to the next shard with room. Documents on one arc
(between two points) share one order of shards, so filling the shards needs
only the count of each arc: the plan is made on the driver from at most
shards x points numbers, and a document finds its shard from its place within
its arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import row_key, running_totals, stage_table, text_or_empty

SHARDS = 8
POINTS = 64
LAW = "rows"


def ring_points(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes (sorted signed 64-bit) and their shards."""
    at = [(int.from_bytes(hashlib.blake2b(f"shard {s} point {p}".encode(), digest_size=8).digest(), "big",
                          signed=True), s) for s in range(shards) for p in range(points)]
    at.sort()
    return np.array([a for a, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int64)


def fill_ring(counts: dict[int, int], owners: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int]]:
    """Share out the arcs: runs ``(arc, keys, shard)`` in order of arc.

    In round k every arc sends its keys still without a shard to the k-th
    distinct shard clockwise; arcs are served in ring order, each as far as
    the shard has room. Capacities that sum to the keys fill exactly.
    """
    arcs, shards = len(owners), len(capacity)
    room, left = list(capacity), [counts.get(a, 0) for a in range(arcs)]
    ways = []
    for a in range(arcs):
        way: list[int] = []
        for i in range(arcs):
            s = int(owners[(a + i) % arcs])
            if s not in way:
                way.append(s)
                if len(way) == shards:
                    break
        ways.append(way)
    given: list[list[tuple[int, int]]] = [[] for _ in range(arcs)]
    for k in range(shards):
        for a in range(arcs):
            n = min(left[a], room[ways[a][k]])
            if n:
                given[a].append((n, ways[a][k]))
                room[ways[a][k]] -= n
                left[a] -= n
    return [(a, n, s) for a in range(arcs) for n, s in given[a]]


def shard(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """Put every row of ``docs`` into a shard, none of which is more than one
    row larger than another (law ``rows``: the load bound of the ring is the
    mean, rounded up for the first shards and down for the others).

    Returns ``doc_id``, ``row_key``, ``size`` (UTF-8 bytes of the text, null:
    none, plus 1), ``text_crc32``, ``law``, ``shard``, ``slot`` (place in the
    shard, gapless from 0) and ``grown_shard`` (null under this law). The key
    is ``doc_id``; a null doc_id is a key as any other. Equal keys share a
    place on the ring but not always a shard, as a shard may fill up between
    them. An empty table gives an empty result.
    """
    at, owners = ring_points(shards, points)

    @F.pandas_udf("int")
    def arc_of(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in places:
            yield pd.Series(np.searchsorted(at, x.to_numpy()) % len(at), dtype="int32")

    key = row_key(docs)
    base = docs.select(
        "doc_id", key.alias("row_key"), (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text_or_empty(), "utf-8")).alias("text_crc32"),
        F.xxhash64("doc_id").alias("place"), F.xxhash64(F.lit(1), F.col("doc_id"), key).alias("order"))
    base = stage_table(base.withColumn("arc", arc_of("place")).drop("place"), "places")
    counts = {r["arc"]: r["n"] for r in base.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    plan = fill_ring(counts, owners, [rows // shards + (s < rows % shards) for s in range(shards)])

    # the runs, laid end to end, cover the arcs' keys one after the other
    first = np.concatenate([[0], np.cumsum([counts.get(a, 0) for a in range(len(at))])]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum([n for _, n, _ in plan])]).astype(np.int64)[:-1]
    owner = np.array([s for _, _, s in plan], dtype=np.int64)
    used, slot = [0] * shards, []
    for _, n, s in plan:
        slot.append(used[s])
        used[s] += n
    slot0 = np.array(slot, dtype=np.int64)

    @F.pandas_udf("struct<shard:int,slot:bigint>")
    def placed(arcs: pd.Series, before: pd.Series) -> pd.DataFrame:
        n = first[arcs.to_numpy()] + before.to_numpy()
        run = np.searchsorted(start, n, side="right") - 1
        return pd.DataFrame({"shard": owner[run].astype("int32"), "slot": slot0[run] + n - start[run]})

    ranked = running_totals(base, ["arc"], "order", ["doc_id", "row_key"], None, rows)
    return ranked.withColumn("_to", placed("arc", "before")).select(
        "doc_id", "row_key", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit(LAW).alias("law"),
        F.col("_to.shard").alias("shard"), F.col("_to.slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))

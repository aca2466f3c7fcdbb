"""Packing documents into sequences by minimum bin slack.

A sequence is filled with the largest piece that is left and the fullest
combination of other lengths that still fits beside it, found by subset sums
in a bitset. The pieces enter only as counts per length, at most one number
per length up to the capacity, so the plan is made on the driver however many
pieces there are, and a combination is used as often as its lengths last.
Each piece then finds its sequence from its place among the pieces of its
length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import running_totals, stage_table
from mensura.llm.tokens import END_ID, encode_slices, vocabulary_path

CAPACITY = 2048


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination ``[(length, times)]`` whose sum is the largest that is
    at most ``room``; bit t of ``reach`` says that the sum t can be made."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        add = reach
        for _ in range(min(counts[length], room // length)):
            add = (add << length) & mask
            if not add:
                break
            reach |= add
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        times = 0
        while not (before >> total) & 1:
            total -= length
            times += 1
        if times:
            out.append((length, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences as ``(how many, [(length, times)])``; every piece is in one."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        mixed = dict(fullest(rest, capacity - largest))
        mixed[largest] = mixed.get(largest, 0) + 1
        times = min(left[x] // m for x, m in mixed.items())
        out.append((times, sorted(mixed.items(), reverse=True)))
        for x, m in mixed.items():
            left[x] -= m * times
            if not left[x]:
                del left[x]
    return out


def cut(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID,
        with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text (null: empty)
    and its end id. Only a longer document is cut; its first piece takes what
    the full ones leave. Columns: ``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit)."""
    vocabulary = vocabulary or vocabulary_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            rows = []
            for i, ids in encode_slices(vocabulary, batch.column("text"), end_id):
                stops = range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)
                start = 0
                for k, stop in enumerate(stops):
                    raw = ids[start:stop].tobytes()
                    rows.append((names[i], k, start, stop - start, zlib.crc32(raw), raw if with_ids else None))
                    start = stop
            if rows:
                c = list(zip(*rows))
                out = {"doc_id": pa.array(c[0], pa.int64()), "piece": pa.array(c[1], pa.int32()), "start": c[2],
                       "length": c[3], "ids_crc32": c[4]}
                if with_ids:
                    out["ids"] = pa.array(c[5], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(pieces, kind + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Pack all documents; the columns of ``cut`` with ``sequence_id`` (from
    0, gapless) and ``offset`` (place in the sequence, gapless from 0).

    Repeated rows and null doc_ids are packed as any other; an empty text is
    its end id alone; an empty table gives an empty result. Which of the
    pieces of one length goes where is decided by a hash of their columns, so
    reruns agree.
    """
    pieces = stage_table(cut(docs, vocabulary, capacity, end_id, with_ids).withColumn(
        "_order", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}

    # runs of places per length: (length, first place, copies per sequence, first sequence, offset)
    used, runs, sequence = dict.fromkeys(counts, 0), [], 0
    for times, mixed in plan(counts, capacity):
        offset = 0
        for length, m in mixed:
            runs.append((length, used[length], m, sequence, offset))
            used[length] += m * times
            offset += m * length
        sequence += times
    base = np.zeros(capacity + 2, dtype=np.int64)
    for length, n in counts.items():
        base[length + 1] = n
    base = np.cumsum(base)  # base[length]: pieces of smaller lengths
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    first = base[table[:, 0]] + table[:, 1]

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pd.Series, before: pd.Series) -> pd.DataFrame:
        n = length.to_numpy()
        place = base[n] + before.to_numpy()
        run = np.searchsorted(first, place, side="right") - 1
        k, m = place - first[run], table[run, 2]
        return pd.DataFrame({"sequence_id": table[run, 3] + k // m, "offset": table[run, 4] + k % m * n})

    ranked = running_totals(pieces, ["length"], "_order", ["doc_id", "piece", "start"], None, sum(counts.values()))
    return ranked.withColumn("_to", placed("length", "before")).select(
        *[c for c in pieces.columns if c != "_order"], "_to.sequence_id", "_to.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: one row
    per ``sequence_id`` with ``ids`` (little-endian unsigned 32-bit), at most
    the capacity of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

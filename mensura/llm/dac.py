"""Token ids as directly addressable codes.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id,
level 1 the next chunk of those ids that need one, and so on. A bitmap beside
each level but the last says which of its ids go on, and a rank directory
holds the number of set bits before each block of 512, so the place of an id
on the next level is one directory entry and one short popcount away. Any id
is read without touching the ids around it.

A file is a Parquet table written by Spark; each row is one segment, a blob
of whole documents in ascending ``doc_id`` order with a table of their
starts. Partition numbers follow ``doc_id``, so partition by partition and
segment by segment the files hold all documents in that order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import row_key
from mensura.llm.tokens import END_ID, encode_slices, vocabulary_path

BLOCK = 512
#: A segment is closed at the first document that brings it to this many ids.
SEGMENT_TOKENS = 1 << 18
_HEAD = struct.Struct("<4sQQI")
_MAGIC = b"DAC1"
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray, docs: list[int | None], lengths: list[int]) -> bytes:
    """One segment: its documents' ids as directly addressable codes."""
    ids = np.asarray(ids, dtype=np.uint32)
    levels = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    out = [_HEAD.pack(_MAGIC, len(ids), len(docs), levels),
           np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
           np.array([d is None for d in docs], dtype=np.uint8).tobytes(), starts.tobytes()]
    rest = ids
    for level in range(levels):
        out.append(struct.pack("<Q", len(rest)))
        out.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        if level < levels - 1:
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
            per_block = _POP[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(per_block)]).astype("<u4").tobytes()]
            rest = rest[more]
    return b"".join(out)


class Segment:
    """Reads a packed segment."""

    def __init__(self, blob: bytes):
        magic, self.n, n_docs, levels = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a segment of token ids")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            x = np.frombuffer(blob, dtype=kind, count=n, offset=at)
            at += x.nbytes
            return x

        ids, none = take("<i8", n_docs), take(np.uint8, n_docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, none)]
        self.starts = take("<i8", n_docs + 1)
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for level in range(levels):
            n = int(take("<u8", 1)[0])
            chunks = take(np.uint8, n)
            if level == levels - 1:
                self.levels.append((chunks, None, None))
            else:
                blocks = -(-n // BLOCK)
                bits = take(np.uint8, blocks * (BLOCK // 8))
                self.levels.append((chunks, bits, take("<u4", blocks + 1)))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place ``i`` of a level."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        n, byte = int(ranks[block]), i // 8
        n += int(_POP[bits[block * (BLOCK // 8):byte]].sum())
        return n + (int(_POP[bits[byte] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def access(self, i: int) -> int:
        """Id ``i`` of the segment, by its chunks alone."""
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if bits is None or not (bits[i // 8] >> (i % 8)) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """Ids ``start`` to ``stop``: each level's chunks are one range, found by rank."""
        chunks, bits, _ = self.levels[level]
        out = chunks[start:stop].astype("<u4")
        if bits is not None and stop > start:
            lo = start // 8
            more = np.unpackbits(bits[lo:-(-stop // 8)], bitorder="little")[start - lo * 8:stop - lo * 8] > 0
            if more.any():
                first = self._rank(level, start)
                out[more] |= self.slice(first, first + int(more.sum()), level + 1) << np.uint32(8)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


_SEGMENTS = "part int, segment int, before bigint, n_docs bigint, n_tokens bigint, data binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = END_ID,
                 segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text and write the ids to ``path`` by ascending
    ``doc_id`` (null first, repeats by content). A null text is empty, and an
    empty text has the end id alone. Other columns are ignored; an empty
    table writes no segments.
    """
    vocabulary = vocabulary or vocabulary_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, names, lengths, n, before, k = [], [], [], 0, 0, 0

        def close():
            data = pack(np.concatenate(ids), names, lengths)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([k], pa.int32()), "before": [before],
                "n_docs": [len(names)], "n_tokens": [n], "data": pa.array([data], pa.binary())})

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, x in encode_slices(vocabulary, batch.column("text"), end_id):
                ids.append(x)
                names.append(doc_ids[i])
                lengths.append(len(x))
                n += len(x)
                if n >= segment_tokens:
                    yield close()
                    before, k = before + n, k + 1
                    ids, names, lengths, n = [], [], [], 0
        if names:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        row_key(docs).alias("_key"))
    (keyed.repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key").select("doc_id", "text")
     .mapInArrow(segments, _SEGMENTS).write.option("compression", "none").parquet(path))


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files at ``path``: ``doc_id``, ``start`` (ids before
    it in all files), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers) and, if asked for, ``ids`` in that form.

    Only one count per written partition comes to the driver.
    """
    files = spark.read.schema(_SEGMENTS).parquet(path)
    totals = dict(files.groupBy("part").agg(F.sum("n_tokens")).collect())
    offsets, n = {}, 0
    for part in sorted(totals):
        offsets[part] = n
        n += totals[part]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "data"))):
                s = Segment(blob)
                raw = [s.document(k).tobytes() for k in range(len(s.docs))]
                out = {"doc_id": pa.array(s.docs, pa.int64()), "start": s.starts[:-1] + (offsets[part] + before),
                       "n_tokens": np.diff(s.starts),
                       "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return files.select("part", "before", "data").mapInArrow(documents, kind)

"""Embeddings as whole numbers, for the operators that calculate exactly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256
_CODE = [T.StructField("dim", T.IntegerType()), T.StructField("code", T.BinaryType())]


def whole(embedding: str = "embedding") -> Column:
    """True for an embedding that takes part: not null, no null, NaN or infinite entry."""
    def fine(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.col(embedding).isNotNull() & F.forall(embedding, fine)


def integer_codes(vectors: DataFrame, keep: Sequence[str], scale: int = SCALE) -> DataFrame:
    """``keep`` columns, ``dim`` and ``code`` of the rows whose ``embedding``
    is ``whole``: floor(``scale`` * x) of each entry, as doubles, in 64-bit
    little-endian integers. Products beyond 2^62 are held at 2^62."""
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            data = np.clip(np.floor(flat * scale), -2.0**62, 2.0**62).astype("<i8").tobytes()
            at = (x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py()) * 8
            columns = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {
                "dim": pa.array(np.diff(at) // 8, pa.int32()),
                "code": pa.array([data[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())})

    rows = vectors.filter(whole()).select(*keep, F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(codes, T.StructType([rows.schema[c] for c in keep] + _CODE))


def matrix(codes: Sequence[bytes] | pa.Array, dim: int) -> np.ndarray:
    """Rows of 64-bit integers from their codes."""
    if isinstance(codes, pa.Array):
        codes = codes.to_pylist()
    return np.frombuffer(b"".join(codes), dtype="<i8").reshape(len(codes), dim)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer query; Python's
    integers where doubles may not do."""
    if not vectors.size:
        return np.zeros(len(vectors), dtype=np.int64)
    most = float(np.abs(vectors).max()) * float(np.abs(query).max()) * vectors.shape[1]
    if most < 2.0**53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return vectors.astype(object) @ query.astype(object)

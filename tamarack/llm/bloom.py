"""Bloom filters of bounded size that go to all tasks, so that only likely rows are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: 1 MB. A filter of more keys lets more rows through; results do not depend on it.
MOST_BITS = 1 << 23
HASHES = 4


def keys_of(values: list[bytes]) -> np.ndarray:
    """The first 16 bytes of each value as two numbers."""
    return np.frombuffer(b"".join(v[:16] for v in values), ">u8").reshape(-1, 2).astype(np.uint64)


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = keys.T
    return [((a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(bits)).astype(np.int64) for i in range(HASHES)]


def make(keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    for at in places(keys, bits):
        out[at] = True
    return np.packbits(out)


def may_contain(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in places(keys, len(packed) * 8):
        ok &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def bloom_of(keys: DataFrame, n: int) -> bytes:
    """A filter of a column of n binary values (16 bytes at least); tasks fill filters of their own, 16 of which meet at the driver."""
    bits = min(MOST_BITS, max(1 << 13, 1 << (n * 10).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                total |= make(keys_of(batch.column(0).to_pylist()), bits)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["f"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.coalesce(16).mapInArrow(run, "f binary").toLocalIterator():
        out |= np.frombuffer(row["f"], np.uint8)
    return out.tobytes()


def passing(df: DataFrame, column: str, packed: bytes) -> DataFrame:
    """Rows of df whose value of a binary column the filter lets through: all that are in it and few others."""
    known = df.sparkSession.sparkContext.broadcast(packed)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(may_contain(bits, keys_of(batch.column(at).to_pylist()))))

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))

"""Scalar kernels: checksums, little-endian numbers, checked arithmetic, paths, times and error details."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import le64 as le64

#: CRC-32C: the Castagnoli polynomial, reflected.
POLYNOMIAL = 0x82F63B78

# Error codes, whether a retry may help, and whether the result may have come about all the same.
ERRORS = {
    "INVALID_ARGUMENT": (False, False), "UNAUTHENTICATED": (False, False), "PERMISSION_DENIED": (False, False), "STREAM_NOT_FOUND": (False, False),
    "SEQUENCE_AHEAD": (False, False), "SEQUENCE_CONFLICT": (False, False), "RECORD_TOO_LARGE": (False, False), "RESOURCE_EXHAUSTED": (True, False),
    "DURABILITY_UNAVAILABLE": (True, False), "NOT_LEADER": (True, False), "REPLICA_UNAVAILABLE": (True, False), "DEADLINE_EXCEEDED": (True, True),
    "SLOW_CONSUMER": (True, False), "DATA_LOSS": (False, True),
}


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def crc32c_bytes(data: bytes, table: np.ndarray | None = None) -> int:
    t = (_table() if table is None else table).tolist()
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc >> 8) ^ t[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def crc32c(data: Column) -> Column:
    """CRC-32C of binary data as a long; null of null. Spark has no built-in. All values of a batch advance together,
    a byte a step, so a batch costs as many numpy steps as its longest value has bytes."""

    def batch(values: pd.Series) -> pd.Series:
        table, n = _table(), values.map(lambda v: -1 if v is None else len(v)).to_numpy()
        order = np.argsort(-n, kind="stable")
        lengths, crc = n[order], np.full(len(n), 0xFFFFFFFF, np.uint32)
        joined = np.frombuffer(b"".join(v for v in values if v is not None), np.uint8)
        starts = (np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0))[order]
        for j in range(int(max(n.max(), 0)) if len(n) else 0):
            m = int(np.searchsorted(-lengths, -j, side="left"))
            crc[:m] = (crc[:m] >> np.uint32(8)) ^ table[(crc[:m] ^ joined[starts[:m] + j]) & np.uint32(255)]
        out = np.empty(len(n), np.int64)
        out[order] = crc ^ np.uint32(0xFFFFFFFF)
        return pd.Series(out, dtype="Int64").mask(n < 0)

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "long")(data)


def aligned(n: Column, to: int) -> Column:
    """n rounded up to a multiple of `to`; null on overflow."""
    up = F.try_add(n.cast("long"), F.lit(to - 1).cast("long"))
    return up - F.pmod(up, F.lit(to).cast("long"))


def saturating_multiply(a: Column, b: Column) -> Column:
    """a * b of numbers of 0 and more, or the largest long where that overflows."""
    return F.coalesce(F.try_multiply(a.cast("long"), b.cast("long")), F.when(a.isNotNull() & b.isNotNull(), F.lit((1 << 63) - 1)))


def relative_path(path: Column) -> Column:
    """Whether a path stays below its root: not empty or absolute, without backslash, and no part empty, '.' or '..'."""
    parts = F.split(path, "/")
    return F.coalesce((F.length(path) > 0) & ~F.contains(path, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def from_nanos(ns: Column) -> Column:
    """The timestamp of nanoseconds since 1970, to the microsecond below."""
    return F.timestamp_micros(F.floor(ns.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")).cast("long"))


def error_detail(code: Column, name: str) -> Column:
    """Whether an error is retryable (name 'retryable') or its result uncertain ('uncertain'); null of other codes."""
    at = ("retryable", "uncertain").index(name)
    return F.create_map(*[F.lit(x) for k, v in ERRORS.items() for x in (k, v[at])])[code]

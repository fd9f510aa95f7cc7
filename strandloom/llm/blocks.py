"""Exchange of packed numpy columns between Spark partitions.

A shuffle of hundreds of millions of tiny rows is bound by per-row costs.  Here
every map task groups its rows by their target partition in numpy and emits a
few binary rows (partition, payload); Spark moves those, and the receiving task
joins the payloads into whole columns again.  The payloads are compressed, so
that sorted ids cost little.  Nothing is kept outside Spark's own shuffle, so a
lost executor's part is made again from lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import flat

WIRE = "pid INT, data BINARY"
_SCHEMA = pa.schema([("pid", pa.int32()), ("data", pa.binary())])
#: Bytes that a task holds before it emits them.
HOLD_BYTES = 24_000_000


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width; every exchange uses it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(columns: list[np.ndarray]) -> bytes:
    """One payload from columns of equal length: byte planes, compressed."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T).tobytes() for c in columns]
    raw = b"".join(planes)
    return len(raw).to_bytes(8, "little") + n.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The columns of a payload, given their numpy types."""
    size, n = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw = np.frombuffer(pa.decompress(data[16:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


class Outbox:
    """Rows to send, by target partition; emits packed batches when enough are held."""

    def __init__(self, n: int, hold: int = HOLD_BYTES):
        self.n, self.hold, self.held, self.parts = n, hold, 0, []

    def add(self, target: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(target):
            self.parts.append((target.astype(np.int32), columns))
            self.held += sum(c.nbytes for c in columns)
            if self.held >= self.hold:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        target = np.concatenate([t for t, _ in self.parts])  # columns may have several values a row
        columns = [np.concatenate(c) for c in zip(*(c for _, c in self.parts))]
        self.parts, self.held = [], 0
        order = np.argsort(target, kind="stable")
        bounds = np.searchsorted(target[order], np.arange(self.n + 1))
        columns = [c[order] for c in columns]
        full = np.flatnonzero(np.diff(bounds))
        data = [pack([c[bounds[p] : bounds[p + 1]] for c in columns]) for p in full]
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array(data, pa.binary())], schema=_SCHEMA)


def gather(batches: Iterable[pa.RecordBatch], kinds: list[str]) -> list[np.ndarray]:
    """All columns that reached this partition."""
    parts = [unpack(d.as_py(), kinds) for b in batches for d in b.column(1)]
    if not parts:
        return [np.zeros(0, dtype=k) for k in kinds]
    return [np.concatenate(c) for c in zip(*parts)]


def send(df: DataFrame, fn: Callable, n: int) -> DataFrame:
    """Run fn (Arrow batches to packed batches) and bring each payload to its partition."""
    return df.mapInArrow(flat.released(fn), WIRE).repartitionById(n, "pid")


def by_id(ids: np.ndarray, n: int) -> np.ndarray:
    """The partition of each id."""
    return (flat.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int64) % n


def by_hash(values: np.ndarray, n: int) -> np.ndarray:
    """The partition of each uniform 64-bit hash."""
    return (values >> np.uint64(33)).astype(np.int64) % n

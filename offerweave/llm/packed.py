"""Packed exchanges: numpy arrays travel between tasks as a few compressed binary rows.

A row is (part, blob): ``part`` is the partition that reads it. Moving millions of small records
this way costs the JVM a few rows, and the bytes shuffled are compressed together.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, blob binary"
LEVEL = 3
#: Blobs shorter than this are not compressed.
PLAIN = 200
#: Spark partitions of an exchange at most; where more buckets are named, a partition holds several
#: and is sorted by bucket, so that its task works on one after another.
MOST_PARTS = 20_000


def pack(*arrays: np.ndarray | bytes, level: int = LEVEL) -> bytes:
    parts = [bytes([len(arrays)])]
    for x in arrays:
        x = np.frombuffer(x, np.uint8) if isinstance(x, (bytes, bytearray)) else np.ascontiguousarray(x)
        parts += [struct.pack("<cI", x.dtype.char.encode(), x.size), x.tobytes()]
    raw = b"".join(parts)
    return b"\0" + raw if len(raw) < PLAIN else b"\1" + zstandard.ZstdCompressor(level=level).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(memoryview(blob)[1:]) if blob[0] else blob[1:]
    at, out = 1, []
    for _ in range(raw[0]):
        kind, size = struct.unpack_from("<cI", raw, at)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, kind, size, at + 5))
        at += 5 + size * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Values that are not negative, in the smallest unsigned kind that holds them."""
    most = int(x.max(initial=0))
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def rows(found: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(part, blob) pairs as record batches of a few MB."""
    parts, blobs, held = [], [], 0
    for part, blob in found:
        parts.append(part)
        blobs.append(blob)
        held += len(blob) + 64
        if held > 4_000_000:
            yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])
            parts, blobs, held = [], [], 0
    if parts:
        yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def send(df: DataFrame, parts: int) -> DataFrame:
    """Bring the rows of each bucket 0 .. parts - 1 together, for a task that works ``by_bucket``."""
    if parts <= MOST_PARTS:
        return df.repartitionById(parts, F.col("part"))
    return ordered(df.repartitionById(MOST_PARTS, F.col("part") % MOST_PARTS), parts)


def ordered(df: DataFrame, parts: int) -> DataFrame:
    """Partitions of many buckets, sorted by bucket."""
    return df.sortWithinPartitions("part") if parts > MOST_PARTS else df


def share(df: DataFrame, parts: int) -> DataFrame:
    """As send(), by a hash of the bucket: an exchange that several plans read but that is written
    once, and that together() unites with others without moving it again."""
    return df.repartition(min(parts, MOST_PARTS), "part")


def together(a: DataFrame, b: DataFrame, parts: int) -> DataFrame:
    """The rows of two shared exchanges, each bucket's in one task. Spark unites partitions that are
    dealt alike one by one; where that is switched off, the rows are dealt again."""
    both = a.unionByName(b)
    if a.sparkSession.conf.get("spark.sql.unionOutputPartitioning") != "true":
        both = share(both, parts)
    return ordered(both, parts)


def by_bucket(fn: Callable, parts: int) -> Callable:
    """``fn`` over the batches of one bucket at a time. A partition has few buckets and is gathered,
    or many (more than MOST_PARTS exist) and comes sorted; then ``fn`` must read all it is given."""

    def runs(batches):
        for batch in batches:
            part = np.asarray(batch.column("part"))
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield int(part[a]), batch.slice(a, b - a)

    def in_order(batches):
        for _, own in groupby(runs(batches), key=itemgetter(0)):
            yield from fn(batch for _, batch in own)

    def gathered(batches):
        held = {}
        for part, batch in runs(batches):
            held.setdefault(part, []).append(batch)
        while held:
            yield from fn(held.pop(next(iter(held))))

    return in_order if parts > MOST_PARTS else gathered


def blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        yield from batch.column("blob").to_pylist()


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(p, positions of p in ``part``), for each p that occurs, positions in order."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1)) if parts <= 4 * part.size else None
    if ends is not None:
        for p in np.flatnonzero(np.diff(ends)):
            yield int(p), order[ends[p] : ends[p + 1]]
    elif part.size:
        kept = part[order]
        edges = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(kept[a]), order[a:b]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def deal(x: np.ndarray, parts: int) -> np.ndarray:
    """Scrambled 64-bit values to parts 0 .. parts - 1."""
    return (((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``size`` bytes of ``column`` each."""
    _, offsets = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(int64 values, null as the largest; mask of nulls)."""
    null = np.asarray(column.is_null())
    return np.asarray(column.fill_null(np.iinfo(np.int64).max), np.int64), null


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def give_back() -> None:
    """Return freed memory to the system, as an idle worker would keep it beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``fn`` over each partition's record batches."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``fn`` over each partition's record batches; it yields (part, blob)."""

    return map_batches(df, lambda batches: rows(fn(batches)), SCHEMA)

"""Hashes of many rows on their way to the buckets where equal ones meet, packed: one row for each bucket and task.

A row of (hash, row id) of its own costs several times its content in a shuffle, and a grouping joined back to its rows ships
them twice.  Here the entries of a task are held until there are ``FLUSH`` for each bucket, and each bucket's are sent as one
binary value; the bucket sees all entries of its hashes at once.  Buckets follow the number of entries, not of partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PACKED = "bucket int, n int, packed binary"
#: Entries of a bucket, about; below so many in all, one bucket is enough.
ENTRIES, LEAST = 1 << 20, 1 << 16
#: Entries that a task holds for each bucket before it sends them, and at most in all.
FLUSH, HELD = 1 << 15, 1 << 19


def buckets_of(entries: int, tasks: int) -> int:
    """Buckets for so many entries: one for each task where none gets fewer than ``LEAST``, more where one gets too many."""
    return max(1, min(tasks, -(-entries // LEAST)), -(-entries // ENTRIES))


def _encoded(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Bytes of one rank together; whole columns are sent as differences, which are mostly 0 or small inside a text."""
    whole = [np.diff(c, prepend=np.uint64(0)) if w == 8 else c for c, w in zip(columns, widths)]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T[:w] for c, w in zip(whole, widths)]
    return pa.compress(np.ascontiguousarray(np.concatenate(planes)), codec="zstd", asbytes=True)


def _rows(columns: list[np.ndarray], by: int, widths: list[int], buckets: int) -> pa.RecordBatch:
    bucket = ((columns[by] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order].astype(np.int32), [c[order] for c in columns]
    at = np.r_[np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
    sent = [_encoded([c[i:j] for c in columns], widths) for i, j in zip(at[:-1], at[1:])]
    return pa.record_batch(
        [pa.array(bucket[at[:-1]], pa.int32()), pa.array(np.diff(at), pa.int32()), pa.array(sent, pa.binary())], ["bucket", "n", "packed"]
    )


def packed(parts: Iterable[list[np.ndarray]], by: int, widths: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns of unsigned 64-bit numbers as rows of ``PACKED``, dealt by column ``by``, which must be evenly spread hashes.

    Of a column its ``widths`` lowest bytes arrive; ``by`` may leave out high bytes, as the bucket stands for the highest.
    """
    held: list[list[np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= min(HELD, FLUSH * buckets):
            yield _rows([np.concatenate(c) for c in zip(*held)], by, widths, buckets)
            held, size = [], 0
    if size:
        yield _rows([np.concatenate(c) for c in zip(*held)], by, widths, buckets)


def unpacked(table: pa.Table, widths: list[int]) -> list[np.ndarray]:
    """The columns of all packed rows of a bucket."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in widths]
    ends = np.cumsum(widths)
    for n, data in zip(table.column("n").to_pylist(), table.column("packed")):
        planes = np.frombuffer(pa.decompress(data.as_buffer(), int(ends[-1]) * n, codec="zstd"), np.uint8).reshape(-1, n)
        for i, (end, width) in enumerate(zip(ends, widths)):
            whole = np.zeros((n, 8), np.uint8)
            whole[:, :width] = planes[end - width : end].T
            column = whole.reshape(-1).view(np.uint64)
            out[i].append(np.cumsum(column, dtype=np.uint64) if width == 8 else column)
    return [np.concatenate(c) for c in out]

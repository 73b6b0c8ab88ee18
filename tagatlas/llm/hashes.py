"""64-bit hashes in numpy, and counts of them that tasks merge as packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def mixed(a: np.ndarray, b) -> np.ndarray:
    """One hash of two, in this order."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * _ODD[0] + b
        x = (x ^ (x >> np.uint64(29))) * _ODD[1]
        return x ^ (x >> np.uint64(32))


def segment(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range, out of parts equal ones, that holds each key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def unique(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts (1 each without counts)."""
    if counts is None or not len(keys):
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def packed(kind: int, keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, part, keys, counts), one for each range that has a key: what a task has counted, in as few rows as there are ranges."""
    u, n = unique(keys)
    if len(u):
        own, first = np.unique(segment(u, parts), return_index=True)
        ends = list(zip(first, [*first[1:], len(u)], strict=True))
        data = [pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for x in (u, n.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array(own.astype(np.int64)), *data], ["kind", "part", "keys", "counts"])


PACKED = "kind int, part long, keys binary, counts binary"


def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of a group of packed rows and their counts."""
    keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64)
    return unique(keys, np.frombuffer(b"".join(group["counts"].to_pylist()), np.int32).astype(np.int64))


def looked_up(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of keys, 0 for keys that are not known; known is sorted."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are known; known is sorted."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

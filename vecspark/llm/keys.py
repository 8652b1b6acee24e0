"""Sets of 64-bit keys as they travel: sorted, as differences, byte plane by byte plane."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

C1, C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * C1
    x = (x ^ (x >> np.uint64(29))) * C2
    return x ^ (x >> np.uint64(32))


def pack(x: np.ndarray) -> bytes:
    """Ascending integers: the differences' byte planes, so that zero bytes stand together and compress away."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view(np.uint64).ravel(), dtype=np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """Integers in any order."""
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_ints(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and the number of the run of every element."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(len(sorted_keys), bool)
    new[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


def cut(sorted_values: np.ndarray):
    """(value, from, to) of each run."""
    starts, _ = runs(sorted_values)
    for a, b in zip(starts, np.append(starts[1:], len(sorted_values))):
        yield int(sorted_values[a]), int(a), int(b)


def column(table: pa.Table, name: str):
    """A column of one side of a cogroup; a side without rows comes without columns."""
    return table.column(name) if name in table.schema.names else pa.array([], pa.null())


def blobs(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x for x in col.to_pylist() if x is not None]


def joined(col, read, dtype) -> np.ndarray:
    parts = [read(b) for b in blobs(col)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)

"""Vectors as whole numbers: which rows take part, and the compact bytes they travel in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a component is multiplied by before it is cut to a whole number.
SCALE = 256
#: The first byte of a packed vector: 16-bit whole numbers, or whole numbers as doubles.
SMALL, WIDE = b"h", b"d"


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: the rows that take part, their lengths, and ``floor(256 * x)`` of their entries in a row.

    Rows that are null, or hold null or non-finite entries, are left out.  The numbers are whole and
    kept as doubles, which hold ``256 * x`` and its floor exactly.
    """
    lists = column.cast(pa.large_list(pa.float64()), safe=False)
    offsets = np.asarray(lists.offsets)
    values = lists.values
    bad = np.asarray(pc.invert(pc.fill_null(pc.is_finite(values), False)))
    faults = np.concatenate([[0], np.cumsum(bad)])
    keep = (faults[offsets[1:]] == faults[offsets[:-1]]) & np.asarray(pc.is_valid(lists))
    sizes = np.diff(offsets)
    inside = np.zeros(len(values) + 1, np.int64)
    np.add.at(inside, offsets[:-1][keep], 1)
    np.add.at(inside, offsets[1:][keep], -1)
    found = np.asarray(pc.fill_null(values, 0.0))[np.cumsum(inside)[:-1] > 0]
    return np.flatnonzero(keep), sizes[keep], np.floor(SCALE * found) + 0.0


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as bytes; equal ones give equal bytes."""
    small = not x.size or np.abs(x).max() < 1 << 15
    return SMALL + x.astype("<i2").tobytes() if small else WIDE + x.astype("<f8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == SMALL else "<f8", offset=1)


def exact_type(most: float) -> type:
    """In what numbers sums of products up to ``most`` in size are exact: floats, doubles, or Python's integers."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def as_type(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers in a kind of numbers given by ``exact_type``."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape) if kind is object else x.astype(kind)

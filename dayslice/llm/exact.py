"""Exact integer vectors of any size in numpy: machine integers where they suffice, Python's integers beyond."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this size of a component products of 64 million components stay below 2^63, and doubles hold a product of two exactly.
SMALL = 1 << 18
#: Up to this size squares and products of 64 components stay below 2^63.
MIDDLE = 1 << 27
LIMB = 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Width of a number beyond 64 bits as bytes: products of finite doubles times a scale fit.
WIDE_BYTES = 288
_SHIFT = 1 << (8 * WIDE_BYTES - 1)


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, the product taken as a double: int64, or Python integers where one is large.

    A product that overflows a double counts as the largest double of its sign.
    """
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(values * float(scale)), -most, most)
    if scaled.size == 0 or np.abs(scaled).max() < MIDDLE:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)


def fits(*arrays: np.ndarray, terms: int = 64) -> bool:
    """Whether sums of `terms` products of their components (or of squared differences) stay below 2^62."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return terms * (2 * most) ** 2 < 1 << 62


def alike(*arrays: np.ndarray, terms: int = 64) -> tuple[np.ndarray, ...]:
    """The arrays as int64 if sums of products of their components fit, else all as Python integers."""
    kind = np.int64 if fits(*arrays, terms=terms) else object
    return tuple(a.astype(kind) for a in arrays)


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Integer inner products; both sides as `alike` gives them."""
    return rows @ vector if rows.dtype != object else (rows * vector).sum(1)


def squares(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows from one vector or from as many rows."""
    gap = rows - other
    return np.einsum("ij,ij->i", gap, gap) if gap.dtype != object else (gap * gap).sum(1)


def longs(values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(score bigint, wide binary) that sort as the values do, both descending with nulls last; wide is null where the value fits."""
    if values.dtype != object:
        return pa.array(values, pa.int64()), pa.nulls(len(values), pa.binary())
    small, wide = [], []
    for v in map(int, values):
        inside = LEAST < v <= MOST
        small.append(min(max(v, LEAST), MOST))
        wide.append(None if inside else (v + _SHIFT).to_bytes(WIDE_BYTES, "big"))
    return pa.array(small, pa.int64()), pa.array(wide, pa.binary())


def value_of(small: int, wide: bytes | None) -> int:
    """The number that `longs` was given."""
    return int(small) if wide is None else int.from_bytes(wide, "big") - _SHIFT


def by_value(score: str = "score", wide: str = "wide") -> tuple[Column, Column]:
    """The order of `longs`, highest first."""
    return F.desc_nulls_last(score), F.desc_nulls_last(wide)


def limbs(values: np.ndarray) -> list[list[int]]:
    """Integers in base 2^32, least limb first; a sum of limbs is the limb of the sum. The last limb has the sign."""
    out, rest = [], [int(v) for v in values]
    while not out or any(rest):
        if out and all(-(1 << LIMB) < v < 1 << LIMB for v in rest):
            out.append(rest)
            break
        out.append([v & ((1 << LIMB) - 1) for v in rest])
        rest = [v >> LIMB for v in rest]
    return out


def from_limbs(rows: dict[int, list[int]], width: int) -> list[int]:
    """Integers of summed limbs, {place: limbs}."""
    return [sum(int(part[i]) << (LIMB * place) for place, part in rows.items()) for i in range(width)]


def sound_matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix of doubles) of the lists that have `width` components (default: that of the first list), none null or non-finite."""
    lengths = np.diff(column.offsets.to_numpy())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    width = int(lengths[valid][0]) if width is None and valid.any() else (width or 0)
    keep = np.flatnonzero(valid & (lengths == width))
    numbers = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()[:-1][keep][:, None] + np.arange(width)[None, :]
    matrix = numbers[at] if len(keep) else np.zeros((0, width))
    finite = np.isfinite(matrix).all(1)
    return keep[finite], matrix[finite]

"""Similarity of two columns of vectors.

Each runs as one Arrow function over whole batches: where all vectors of a batch are as long and have no null within, as
embeddings are, a batch is two matrices and one pass of numpy. Numbers of any type are made doubles there. Rows with a
null vector are null; vectors of different lengths are an error; pairs of elements of which one is null are left out of
every sum.

Arrays cross to the worker number by number. ``packed`` turns them, once, into binary columns of 32-bit floats, which cross
as they are and which all functions here take too; tables of embeddings are best written so.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import to_col


def _numbers(v: pa.Array) -> pa.Array:
    """A column of vectors as lists; packed ones without a copy."""
    if not (pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type)):
        return v
    known, offsets, data = v.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(v.type) else np.int32)[v.offset : v.offset + len(v) + 1]
    if (ends % 4).any():
        raise ValueError("a packed vector is of whole 32-bit floats")
    numbers = pa.Array.from_buffers(pa.float32(), int(ends[-1]) // 4, [None, data if data is not None else pa.py_buffer(b"")])
    mask = None if not v.null_count else v.is_null()
    return pa.LargeListArray.from_arrays(pa.array(ends // 4, pa.int64()), numbers, mask=mask)


@F.arrow_udf(T.BinaryType())
def _pack(v: pa.Array) -> pa.Array:
    if pa.types.is_null(v.type):
        return pa.nulls(len(v), pa.binary())
    sizes = pc.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)
    data = v.drop_null().flatten().cast(pa.float32(), safe=False).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
    known = pc.is_valid(v)
    packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
    return pc.if_else(known, packed, pa.scalar(None, pa.binary()))


def packed(v) -> Column:
    """A vector as a binary of 32-bit floats; null for null. A null element becomes NaN, so that what is computed with it is NaN."""
    return _pack(to_col(v))


def _pairs(a: pa.Array, b: pa.Array):
    """(rows, x, y) matrices of the rows that have both vectors, zero where an element is missing; grouped by length."""
    both = np.asarray(pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False))
    n, m = (np.where(both, np.asarray(pc.list_value_length(x).fill_null(0)), 0) for x in (a, b))
    if (n != m).any():
        raise ValueError("vectors must have the same length")
    for size in np.unique(n[both]):
        rows = np.flatnonzero(both & (n == size))
        out, missing = [], np.zeros((len(rows), size), bool)
        for v in (a, b):
            flat = (v if len(rows) == len(v) else v.take(pa.array(rows))).flatten().cast(pa.float64())
            if flat.null_count:
                missing |= flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), size)
                flat = flat.fill_null(0.0)
            out.append(flat.to_numpy(zero_copy_only=False).reshape(len(rows), size))
        x, y = (np.where(missing, 0.0, v) for v in out) if missing.any() else out
        yield rows, x, y


def _by_row(f: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        if pa.types.is_null(a.type) or pa.types.is_null(b.type):
            return pa.nulls(len(a), pa.float64())
        a, b = _numbers(a), _numbers(b)
        out, known = np.zeros(len(a)), np.zeros(len(a), bool)
        for rows, x, y in _pairs(a, b):
            out[rows], known[rows] = f(x, y), True
        return pa.array(out, mask=~known)

    return run


def _dot(x, y):
    return np.einsum("ij,ij->i", x, y)


def _cosine(x, y):
    norm = np.sqrt(_dot(x, x)) * np.sqrt(_dot(y, y))
    return np.divide(_dot(x, y), norm, out=np.zeros(len(x)), where=norm > 0)


def _distance(x, y):
    out = np.empty(len(x))
    # A few rows at a time, so that the differences stay in the processor's cache.
    for lo in range(0, len(x), 64):
        d = x[lo : lo + 64] - y[lo : lo + 64]
        out[lo : lo + 64] = _dot(d, d)
    return np.sqrt(out)


_FORMS = {"cosine": _by_row(_cosine), "dot": _by_row(_dot), "distance": _by_row(_distance)}


def cosine_similarity(a, b) -> Column:
    """The cosine of two vectors, 0 if one has no length."""
    return _FORMS["cosine"](to_col(a), to_col(b))


def dot_product(a, b) -> Column:
    return _FORMS["dot"](to_col(a), to_col(b))


def euclidean_distance(a, b) -> Column:
    return _FORMS["distance"](to_col(a), to_col(b))

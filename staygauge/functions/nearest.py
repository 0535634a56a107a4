"""Arrow steps on lists of cells and of places: which of them can be among the nearest.

A list has up to some hundred entries and is looked through for every row, so it is done by numpy on whole batches; as column
functions with lambdas, which Spark interprets entry by entry, these two steps were most of a search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# What a distance may be off, in chords of the unit sphere and in degrees: more than rounding to the millimetre or to nine decimals.
_SLACK = {"haversine": 1e-9, "euclidean": 1e-8}


def _shape(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and for every entry the number of its list."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, np.repeat(np.arange(len(lengths)), lengths)


def _numbers(values: pa.Array, columns: int = 0) -> np.ndarray:
    found = values.to_numpy(zero_copy_only=False)
    return found.reshape(-1, columns) if columns else found


def _reach(far: np.ndarray, weight: np.ndarray, lengths: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """For each list the smallest distance within which entries of weight ``k`` lie, or all if there are fewer."""
    order = np.lexsort((far, row))
    far, weight = np.append(far[order], 0.0), weight[order]
    first = np.cumsum(lengths) - lengths
    before = np.append(np.cumsum(weight) - weight, 0)
    before = before[:-1] - np.repeat(before[first], lengths)
    return far[first + np.bincount(row[before < k], minlength=len(lengths)) - 1]


def _keep(lists: pa.Array, chosen: np.ndarray, row: np.ndarray) -> pa.Array:
    ends = np.cumsum(np.bincount(row[chosen], minlength=len(lists)))
    return pa.ListArray.from_arrays(
        pa.array(np.append(0, ends), pa.int32()), lists.flatten().filter(pa.array(chosen)), type=lists.type, mask=lists.is_null())


def reachable_cells(near: Column, home: Column, k: int, dimensions: int, kind: DataType, side: int = 1) -> Column:
    """The cells of ``near``, an array of (cell, weight, ...), that can hold one of the k nearest references of some point in the
    cell ``home``. ``side``: how many cells as ``home`` fit along one of ``near``.

    The k-th nearest lies within the smallest upper bound that k references respect; a cell whose lower bound is beyond it is out.
    """
    @F.arrow_udf(kind)
    def step(near: pa.Array, home: pa.Array) -> pa.Array:
        lengths, row = _shape(near)
        entries = near.flatten()
        low = _numbers(pc.struct_field(entries, "cell").flatten(), dimensions) * side
        own = _numbers(home.flatten(), dimensions)[row]
        above, below = (low + side - own).astype(float), (own + 1 - low).astype(float)  # from the one's begin to the other's end
        far = np.square(np.maximum(above, below)).sum(axis=1)
        close = np.square(np.maximum(np.maximum(-above, -below), 0)).sum(axis=1)
        limit = np.sqrt(_reach(far, _numbers(pc.struct_field(entries, "weight")), lengths, row, k)) + 1
        # One cell of slack outweighs every rounding in coordinates and distances.
        return _keep(near, np.sqrt(close) <= limit[row], row)

    return step(near, home)


def close_candidates(candidates: Column, position: Column, k: int, metric: str, kind: DataType) -> Column:
    """The candidates (..., ref_lat, ref_long, copies) that may be among the k nearest to ``position``, ties included; all of them
    for a row without a position. The order and the exact distances are left to the caller."""
    @F.arrow_udf(kind)
    def step(candidates: pa.Array, position: pa.Array) -> pa.Array:
        lengths, row = _shape(candidates)
        entries = candidates.flatten()
        lat, long = (_numbers(pc.cast(pc.struct_field(entries, name), pa.float64())) for name in ("ref_lat", "ref_long"))
        if metric == "haversine":
            lat, long = np.radians(lat), np.radians(long)
            places = np.stack([np.cos(lat) * np.cos(long), np.cos(lat) * np.sin(long), np.sin(lat)], axis=1)
        else:
            places = np.stack([lat, long], axis=1)
        own = _numbers(position.flatten(), places.shape[1])
        far = np.sqrt(np.square(places - own[row]).sum(axis=1))
        limit = _reach(far, _numbers(pc.struct_field(entries, "copies")), lengths, row, k)
        limit = limit * (1 + 1e-9) + _SLACK[metric]
        return _keep(candidates, ~(far > limit[row]), row)  # what cannot be compared stays

    return step(candidates, position)

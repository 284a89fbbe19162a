"""One wrapper for all per-pixel kernels: series rows come as Arrow batches, lists become dense (pixels, steps) arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _flat(a: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column; null values are NaN."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    v = a.flatten()
    return np.asarray(v.cast(pa.float64()).fill_null(float("nan"))).astype(kind), np.diff(np.asarray(a.offsets))


def run_kernel(series: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict], fields: str, *, key: str = "pixel", extra: tuple[str, ...] = ()) -> DataFrame:
    """Apply kernel(ts, vs, *extra arrays) -> columns to the pixels of each batch, those of one length together.

    ts: (pixels, steps) int64, vs: (pixels, steps) float64 with NaN for null. The kernel returns a value a pixel, or any
    number of rows with `_row` naming the pixel's index. Memory follows the batch, not the table.
    """
    out = T._parse_datatype_string(f"`{key}` bigint, {fields}")
    names = [f.name for f in out.fields][1:]
    kinds = {f.name: f.dataType for f in out.fields}
    columns = [key, "ts", "vs", *extra]

    def arrow(name: str, values) -> pa.Array:
        t = kinds[name]
        if isinstance(t, T.ArrayType) and isinstance(values, np.ndarray) and values.ndim == 2:
            item = pa.int32() if isinstance(t.elementType, T.IntegerType) else pa.float64()
            flat = pa.array(values.ravel(), from_pandas=True).cast(item)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array(list(values) if isinstance(t, (T.ArrayType, T.StructType)) else values, to_arrow_type(t), from_pandas=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0)
            t, n = _flat(batch.column(1), np.int64)
            v, _ = _flat(batch.column(2), float)
            begin = np.cumsum(n) - n
            more = [np.array(batch.column(3 + i).to_pylist(), dtype=object) for i in range(len(extra))]
            for size in np.unique(n):
                own = np.flatnonzero(n == size)
                at = begin[own][:, None] + np.arange(size)[None]
                got = kernel(t[at], v[at], *[m[own] for m in more])
                rows = np.asarray(got.get("_row", np.arange(len(own))), np.int64)
                cols = [ids.take(pa.array(own[rows])).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [arrow(c, got[c]) for c in names], names=[key, *names])

    return series.select(*columns).mapInArrow(run, out)

"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_array(lengths, values, kind: pa.DataType) -> pa.ListArray:
    """A list column from the lengths of its lists and their values in a row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def slices(batches, rows: int):
    """The batches cut into pieces of at most ``rows`` rows, to bound what is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def share(spark, thing):
    """Broadcast an object as its plain attributes, so that workers needn't import its class."""
    return spark.sparkContext.broadcast(vars(thing))


def shared(kind, ref):
    """The object of :func:`share` again, in a worker."""
    thing = kind.__new__(kind)
    thing.__dict__.update(ref.value)
    return thing

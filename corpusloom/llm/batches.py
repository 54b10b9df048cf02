"""Arrow batches in small steps: a worker holds one batch as Arrow has it, never as Python objects as well."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

STEP = 64


def values(column: pa.Array, step: int = STEP) -> Iterator:
    """The values of a column as Python objects, ``step`` at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def rows(batch: pa.RecordBatch, *columns: str | int, step: int = STEP) -> Iterator[tuple]:
    """Tuples of the named columns."""
    return zip(*(values(batch.column(c), step) for c in columns), strict=True)


def table(found: Sequence[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.RecordBatch:
    """A batch from a list of rows, which may be empty."""
    columns = list(zip(*found, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

"""Arrow batches worked off in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose Python objects are in memory at a time.
PIECE_BYTES = 1 << 20


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of rows whose texts take about `limit` bytes together and
    that are at most 2000; a text beyond the limit is a piece of its own."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(size, size[start] + limit, side="right")) - 1)
        stop = min(stop, start + 2000)
        yield start, stop
        start = stop


def field_lists(lists: pa.Array, *names: str) -> Iterator[list[tuple]]:
    """For each row of an array of structs, tuples of the named fields; none
    for a null. A field that the structs do not have is None."""
    kind = lists.type.value_type
    at = pa.array(lists.offsets).to_pylist() if len(lists) else [0]
    first, last = at[0], at[-1]
    values = lists.values.slice(first, last - first)
    columns = [values.field(n).to_pylist() if kind.get_field_index(n) >= 0 else [None] * len(values) for n in names]
    rows = list(zip(*columns, strict=True))
    if values.null_count:
        rows = [r if ok else (None,) * len(names) for r, ok in zip(rows, values.is_valid().to_pylist(), strict=True)]
    valid = lists.is_valid().to_pylist()
    for k, (a, b) in enumerate(zip(at, at[1:])):
        yield rows[a - first : b - first] if valid[k] else []


def struct_lists(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Lists of tuples as an array of structs, of the list type `kind`."""
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]), pa.int32())
    fields = list(kind.value_type)
    columns = zip(*(t for r in rows for t in r)) if any(rows) else [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(offsets, values, type=kind)

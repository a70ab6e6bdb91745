"""Arrow batches as kernels take them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that a kernel turns into Python's objects at a time.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows: what a kernel holds in Python's objects at once does not grow with Spark's batches."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def token_lists(lists: pa.Array) -> list:
    """to_pylist of lists of strings, faster: a distinct string is made once, and its places share it."""
    words = lists.flatten().dictionary_encode()
    if lists.null_count or words.null_count:
        return lists.to_pylist()
    found = np.empty(len(words.dictionary), object)
    found[:] = words.dictionary.to_pylist()
    flat, ends = found[words.indices.to_numpy()].tolist(), lists.offsets.to_numpy()
    ends = (ends - ends[0]).tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def term_counts_of(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the terms that the lists hold, by row and place in terms; no string becomes Python's."""
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    keys, counts = np.unique(row[at >= 0] * max(len(terms), 1) + at[at >= 0], return_counts=True)
    return keys // max(len(terms), 1), keys % max(len(terms), 1), counts

"""Walking the rows of a partition that is sorted by a key, one batch of whole runs at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    c = batch.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    return c.to_numpy(zero_copy_only=False)


def whole_runs(batches: Iterable[pa.RecordBatch], key: str, limit: int, unique: list[str] | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Yield (rows, hot): tables that hold whole runs of equal key, or a part of a hot run.

    A run of more than limit rows is hot; it is passed on in parts (hot=True), never held whole, so
    memory is bounded by limit and the batch size. With unique, a row that equals the one before it
    in the key and those columns is dropped first, across batches too; sort by them as well.
    """
    carry: pa.Table | None = None
    hot_key = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch)
        if unique is not None:
            cols = [column(t, c) for c in (key, *unique)]
            new = np.ones(t.num_rows, bool)
            if t.num_rows > 1:
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            new[0] = last is None or any(c[0] != v for c, v in zip(cols, last))
            last = [c[-1] for c in cols]
            if not new.all():
                t = t.filter(pa.array(new))
                if not t.num_rows:
                    continue
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
            carry = None
        keys = column(t, key)
        if hot_key is not None:
            end = int(np.searchsorted(keys != hot_key, True)) if keys[0] == hot_key else 0
            if end:
                yield t.slice(0, end), True
            if end == len(keys):
                continue
            t, keys, hot_key = t.slice(end), keys[end:], None
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        start = int(change[-1]) if len(change) else 0
        if len(change):
            # a run inside the batch may itself be longer than the limit
            bounds = np.concatenate([[0], change])
            size = np.diff(bounds)
            long = np.flatnonzero(size > limit)
            at = 0
            for i in long:
                if bounds[i] > at:
                    yield t.slice(at, int(bounds[i]) - at), False
                yield t.slice(int(bounds[i]), int(size[i])), True
                at = int(bounds[i] + size[i])
            if start > at:
                yield t.slice(at, start - at), False
        carry = t.slice(start)
        if carry.num_rows > limit:
            yield carry, True
            hot_key, carry = keys[-1], None
    if carry is not None:
        yield carry, False

"""Arrow batches: cut by bytes, and of sorted rows where a group ends, so that many small groups go through numpy together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH, UNSAID = "4m", "67108864b"  # the second is Spark's own default
ROWS = 1 << 16  # of a batch, unless its last group is longer


def short_batches(spark: SparkSession) -> None:
    """Cut the Arrow batches of this session by ``BATCH`` bytes, unless it says otherwise: ten thousand texts at a time are many megabytes, held by the executor and its worker alike."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == UNSAID:
        spark.conf.set(name, BATCH)


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a new group begins in rows sorted by ``keys``, none of which is null; the first row begins one."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in keys:
        column = batch.column(k)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of about so many rows that hold whole groups, each with the places where its groups begin and, last, its number of rows."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < enough:
            continue
        one = pa.concat_batches(held)
        at = starts(one, keys)
        if at[-1]:
            yield one.slice(0, at[-1]), at
        held = [one.slice(at[-1])]
        n = held[0].num_rows
        enough = max(rows, 2 * n)  # so that a long group isn't put together anew for each batch
    if held:
        one = pa.concat_batches(held)
        yield one, np.append(starts(one, keys), one.num_rows)

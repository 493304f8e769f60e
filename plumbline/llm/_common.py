"""What several operators share: scratch tables in the shared folder, Arrow columns, table readers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any, Generic, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.groups import short_batches
from plumbline.sources.scratch import materialize, release, scratch_path

__all__ = ["Recent", "batched", "by_size", "column_of", "columns_of", "forget", "fresh", "give_back", "kept", "materialize", "release", "rows", "scratch_path", "short_batches", "table", "text_bytes", "trim"]

K, V = TypeVar("K", bound=Hashable), TypeVar("V")

SLICE = 128  # rows of an Arrow batch that are Python objects at a time
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one large object that a worker keeps between batches. Workers outlive jobs, so that of another key makes way."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
        gc.freeze()  # the collector needn't walk a large model over and over
        trim()
    return _KEPT[key]


def forget() -> None:
    """Let go of the kept object: for tasks that need their memory otherwise."""
    gc.unfreeze()
    _KEPT.clear()
    give_back()
    trim()


def trim() -> None:
    """Return to the system what the C library holds of freed memory, where that library can."""
    with contextlib.suppress(AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    """Return what Arrow's pool holds of freed batches; by itself it may keep them for as long as the worker lives."""
    pa.default_memory_pool().release_unused()


class Recent(Generic[K, V]):
    """A dictionary in two generations: what isn't asked for while some ``most`` others come in is forgotten, what is asked for stays."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[K, V] = {}
        self.old: dict[K, V] = {}

    def turn(self) -> None:
        """Between two uses: a full ``young`` becomes ``old``."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, keys: set[K]) -> set[K]:
        """Those of ``keys`` that aren't known; all the others are in ``young`` until the next turn."""
        young, old = self.young, self.old
        absent = keys.difference(young)
        young.update({k: old[k] for k in absent if k in old})
        return absent.difference(young)

    def add(self, found: dict[K, V]) -> None:
        self.young.update(found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` is."""
    held = {t.lower() for t in taken}
    while name in held:
        name += "_"
    return name


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The values of the named columns, row by row."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)
            del part
        del batch
        give_back()


def column_of(f: Callable[[Any], Any], kind: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """For an Arrow UDF: ``f`` of each value, some values at a time."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in parts:
            yield pa.array((f(v) for at in range(0, len(values), SLICE) for v in values.slice(at, SLICE).to_pylist()), kind, size=len(values))
            del values
            give_back()

    return run


def columns_of(f: Callable[[list], list], kind: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """For an Arrow UDF: ``f`` of some values at a time, in order."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in parts:
            found: list = []
            for at in range(0, len(values), SLICE):
                found += f(values.slice(at, SLICE).to_pylist())
            yield pa.array(found, kind)
            del values, found
            give_back()

    return run


def by_size(records: Iterable[tuple], most: int = 4 << 20) -> Iterator[list[tuple]]:
    """Groups of (id, text) with some ``most`` code points of text each, or one longer text."""
    group, size = [], 0
    for record in records:
        group.append(record)
        size += len(record[1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def batched(schema: pa.Schema, records: Iterator[tuple], limit: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``records``, cut by count and by the bytes of their strings so that memory stays bounded."""
    held: list[tuple] = []
    size = 0
    for record in records:
        held.append(record)
        size += sum(len(x) for x in record if isinstance(x, (str, bytes)))
        if len(held) >= limit or size >= most_bytes:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

"""Document fingerprints by winnowing.

A text's k-grams of code points get rolling polynomial hashes; of every window of w neighbouring grams the least hash is selected,
the rightmost of equals, and its position kept. Any passage of w + k - 1 code points that two texts share gives both a
selected gram inside it (the guarantee), and nothing shorter than k matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import batched, rows

K, W = 16, 48
CHUNK = 1 << 17  # code points hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_EMPTY = np.empty(0, np.uint64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, for one chunk with its overlap."""
    n = CHUNK + 4096
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def rolling_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams: differences of running polynomial sums, shifted to a common power and mixed."""
    up, down = _powers()
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h >> np.uint64(32)


def _window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least value of each window of w, by minima of doubling windows."""
    span = 1
    while span * 2 <= w:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = w - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def selected(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the selected grams, by position.

    A text shorter than the guarantee of w + k - 1 keeps all of its grams; one shorter than k is one gram; an empty one has none.
    """
    n = len(text)
    if not n:
        return _EMPTY, _EMPTY
    if n < k:
        k, w = n, 1
    elif n < w + k - 1:
        w = 1
    out = []
    for at in range(0, n - w - k + 2, CHUNK):
        points = np.frombuffer(text[at : at + CHUNK + w + k - 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = rolling_hashes(points, k)
        # the hash above, the position turned round below: the least is the rightmost of the least hashes
        keys = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(at, at + len(h), dtype=np.uint64))
        least = _window_minima(keys, w)
        out.append(least[np.flatnonzero(np.diff(least, prepend=~least[:1]))])
    keys = out[0] if len(out) == 1 else np.concatenate(out)
    positions = np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))
    fresh = np.diff(positions, prepend=np.uint64(_MASK)) != 0 if len(out) == 1 else np.r_[True, positions[1:] != positions[:-1]]
    return (keys >> np.uint64(32))[fresh], positions[fresh]


def render(hashes: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits a selected gram, by position."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of selected hashes that two fingerprints have in common (Jaccard of sets); 1 for two empty ones."""
    return _sets_alike(np.unique(a), np.unique(b))


def _sets_alike(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(id, fingerprint, hashes, positions) for every row; see ``selected``. Null counts as empty and has none; null ids and repeated rows each keep their row;
    an empty table gives an empty result; other columns are not looked at. A text of any length is one task's. No shuffle."""
    schema = pa.schema([("id", pa.int64()), ("fingerprint", pa.string()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def one(i, text):
        h, p = selected(text, k, w)
        return i, render(h), h.tolist(), p.tolist()

    def run(batches):
        return batched(schema, (one(i, t) for i, t in rows(batches, "id", "text")), limit=512)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "id long, fingerprint string, hashes array<long>, positions array<long>")


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(part, last, at, id, text): rows dealt to ``parts`` ranges of ids, sorted, each range closed by the row that follows it.

    Range ends come from approximate quantiles, so nothing is ordered on one task; only one id a range goes through the driver.
    """
    least = F.lit(-(1 << 63))
    held = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("at"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = held.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 100_000)).first()[0] if parts > 1 else []
    ends = sorted(set(ends or []))
    # two steps of a tree of range ends, so that a row is compared with few of many
    fan = max(1, int(len(ends) ** 0.5))
    groups = [ends[i : i + fan] for i in range(0, len(ends), fan)] or [[]]
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<long>")
    below = lambda xs, at: F.size(F.filter(xs, lambda e: e < at))
    group = F.least(below(array([g[-1] for g in groups if g]), F.col("at")), F.lit(len(groups) - 1))
    part: Column = group * fan + below(F.element_at(F.array(*map(array, groups)), group + 1), F.col("at"))
    firsts = {r[0]: r[1] for r in held.groupBy(part.alias("p")).agg(F.min("at")).collect()}  # one row a range
    filled = sorted(firsts)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    leads = array([firsts.get(p) for p in range(len(ends) + 1)])
    closes = array([before.get(p) for p in range(len(ends) + 1)])
    part_no = F.col("part") + 1
    copies = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("last")))
    closing = F.array(F.struct(F.element_at(closes, part_no).cast("int").alias("part"), F.lit(True).alias("last")))
    dealt = held.withColumn("part", part).withColumn("to", F.explode(F.when(F.col("at") == F.element_at(leads, part_no), F.concat(copies, closing)).otherwise(copies)))
    dealt = dealt.select("to.part", "to.last", "at", "id", "text")
    return dealt.repartitionById(len(ends) + 1, F.col("part")).sortWithinPartitions("part", "last", "at", "text")


def edited(text: str, following: str) -> str:
    """The text whose last quarter (rounded down) is replaced by the first code points of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next row is that of ascending id, then text; the last row's is the first. Null counts as empty and null ids as smallest;
    repeated rows follow one another; a single row follows itself. Texts move once, by ranges of ids; a task holds two rows.
    """
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compared(doc: tuple, following: tuple) -> tuple:
        i, text, hashes, own = doc
        new = edited(text, following[1])
        changed = selected(new, k, w)[0]
        return i, len(text), hashlib.sha256(new.encode()).hexdigest(), render(hashes), render(changed), _sets_alike(own, np.unique(changed)), _sets_alike(own, following[3])

    def each(batches) -> Iterator[tuple]:
        part, doc, closed = None, None, False
        for p, last, i, text in rows(batches, "part", "last", "id", "text"):
            if p != part:
                part, doc, closed = p, None, False
            if closed:
                continue
            hashes = selected(text, k, w)[0]
            now = (i, text, hashes, np.unique(hashes))
            if doc is not None:
                yield compared(doc, now)
            doc, closed = now, last

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_order_with_next(docs, id_col, text_col, parts).drop("at")
    return ordered.mapInArrow(lambda b: batched(schema, each(b), limit=512), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

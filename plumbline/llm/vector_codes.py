"""Product codes of vectors: each part of a vector becomes the index of its nearest codebook entry, fitted by the filtering form of Lloyd's rounds.

Every partition builds kd-trees over the parts of its vectors, one for each part position and stretch of rows, whose nodes keep their bounding
box, sum and count; they are written once and read in each round. Down a tree, an entry that is farther from all of a node's box than another one
is dropped; when one is left, the whole subtree is its. All arithmetic that decides anything is in integers, so ties and sums are exact and
don't depend on how rows are partitioned. What leaves a round is a sum and a count an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm._common import give_back, materialize, release
from plumbline.operators.skew import join_one

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
CHUNK = 4096  # vectors of a tree
LEAF = 16  # and at least so many of a leaf
PIECE = 1 << 20  # numbers of a leaf's distances at a time
TREE = "n int, points binary, place binary, lo binary, hi binary, sums binary"
SUMS = "part int, entry int, at int, total long, n long"


# --- trees: plain numpy over one stretch of rows


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the 2^level nodes of a level begin, and the last one ends; those of the next level lie within."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def _depth(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def plant(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over the rows of ``points``: their order, and the lower and upper corner and the sum of each node, level by level.

    Nodes are halved by count along their box's widest side, so a level's places follow from the number of rows.
    """
    n = len(points)
    order, lo, hi, sums = np.arange(n), [], [], []
    for level in range(_depth(n) + 1):
        bounds = _bounds(n, level)
        if level:
            node = np.repeat(np.arange(len(wide)), np.diff(_bounds(n, level - 1)))
            order = order[np.lexsort((points[order, wide[node]], node))]
        held = points[order]
        lo.append(np.minimum.reduceat(held, bounds[:-1], axis=0))
        hi.append(np.maximum.reduceat(held, bounds[:-1], axis=0))
        sums.append(np.add.reduceat(held, bounds[:-1], axis=0))
        wide = np.argmax(hi[-1] - lo[-1], axis=1)
    return order, np.concatenate(lo), np.concatenate(hi), np.concatenate(sums)


def assign(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first, last, entry, node) of stretches of a tree's points, in its order, with the entry nearest to all of them; ties go to the lower index.

    ``node`` are the numbers of whole nodes, whose sums are known; it is None for single points of leaves.
    """
    n, k = len(points), len(entries)
    at, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    depth = _depth(n)
    for level in range(depth + 1):
        node = at + (1 << level) - 1
        low, high = lo[node], hi[node]
        apart = (((low + high)[:, None] / 2 - entries[None]) ** 2).sum(-1)
        best = np.where(left, apart, np.inf).argmin(1)  # any entry that is left would do
        step = entries[None] - entries[best][:, None]
        # how much farther an entry is than the best one from that corner of the box that suits it most
        corner = np.where(step > 0, high[:, None], low[:, None])
        more = (step * (entries[None] + entries[best][:, None] - 2 * corner)).sum(-1)
        left = left & ~((more > 0) | ((more == 0) & (np.arange(k)[None] > best[:, None])))
        whole = left.sum(1) == 1
        bounds = _bounds(n, level)
        yield bounds[at[whole]], bounds[at[whole] + 1], best[whole], node[whole]
        at, left = at[~whole], left[~whole]
        if not len(at):
            return
        if level < depth:
            at, left = np.stack([2 * at, 2 * at + 1], 1).ravel(), np.repeat(left, 2, axis=0)
    first = bounds[at]
    size = bounds[at + 1] - first
    own = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    which = np.repeat(np.arange(len(at)), size)
    for cut in range(0, len(own), piece := max(1, PIECE // (k * points.shape[1]))):
        rows = own[cut : cut + piece]
        apart = ((points[rows][:, None] - entries[None]) ** 2).sum(-1)
        apart[~left[which[cut : cut + piece]]] = np.iinfo(np.int64).max
        yield rows, rows + 1, apart.argmin(1), None


def codes_of(points: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each row, in the order that rows had before they were planted."""
    out = np.empty(len(points), np.int64)
    for first, last, entry, node in assign(points, lo, hi, entries):
        if node is None:
            out[place[first]] = entry
        else:
            for a, b, e in zip(first, last, entry, strict=True):
                out[place[a:b]] = e
    return out


# --- what tasks do with stretches of rows


def _grow(parts: int, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, CHUNK):
                some = batch.slice(cut, CHUNK)
                n = some.num_rows
                whole = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                width = whole.shape[1] // parts
                if 16 * int(np.abs(whole).max()) ** 2 * width >= 1 << 62:
                    raise ValueError("a component is too large for exact distances in 64 bits")
                grown = [plant(p) + (p,) for p in (np.ascontiguousarray(whole[:, i * width : (i + 1) * width]) for i in range(parts))]
                stack = lambda i, kind: np.stack([g[i] for g in grown]).astype(kind).tobytes()  # noqa: E731, B023
                points = np.stack([g[4][g[0]] for g in grown]).astype(np.int32).tobytes()
                lists = [pa.ListArray.from_arrays([0, n], some.column(c)) for c in ("i", "l")]
                row = [*lists, *([x] for x in (n, points, stack(0, np.int32), stack(1, np.int32), stack(2, np.int32), stack(3, np.int64)))]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(row, kinds.types, strict=True)], schema=kinds)
            give_back()

    return run


def _trees(batches: Iterator[pa.RecordBatch], parts: int, *also: str) -> Iterator[tuple]:
    """(points, place, lo, hi, sums) of each stretch, all by part, and the columns ``also``."""
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            held = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: E731, B023
            by_part = lambda c, rows, kind: held(c, kind).reshape(parts, rows, -1).astype(np.int64)
            nodes = (2 << _depth(n)) - 1
            yield by_part("points", n, np.int32), held("place", np.int32).reshape(parts, n), by_part("lo", nodes, np.int32), by_part("hi", nodes, np.int32), by_part("sums", nodes, np.int64), *(batch.column(c)[i].values for c in also)
        give_back()


def _gather(books: np.ndarray):
    """Of all trees of a task: for each part and entry, the sum and the count of what is nearest to it."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for points, _, lo, hi, sums in _trees(batches, parts):
            for p in range(parts):
                for first, last, entry, node in assign(points[p], lo[p], hi[p], books[p]):
                    np.add.at(total[p], entry, points[p][first] if node is None else sums[p][node])
                    np.add.at(count[p], entry, last - first)
        part, entry = np.nonzero(count)
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(count[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "entry", "at", "total", "n"])

    return run


def _encode(books: np.ndarray):
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for points, place, lo, hi, _, ids, labels in _trees(batches, parts, "i", "l"):
            n = points.shape[1]
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                code[:, p] = codes_of(points[p], place[p], lo[p], hi[p], books[p])
                error[place[p]] += ((points[p] - books[p][code[place[p], p]]) ** 2).sum(1)
            digits = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]), pa.array(error)], ["i", "l", "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256), a row for each vector that is kept; other columns don't come, so none can clash.

    Rows whose vector is null or holds a null or a number that isn't finite are dropped, as are those whose length isn't that of the smallest
    id's vector or no positive multiple of ``parts``, for which there is no codebook. Components become floor(scale * x). The codebooks start
    with the vectors of the ``entries`` smallest ids (nulls last; of equal ids the smallest vector counts), fewer where there are fewer. Each round
    assigns every part to its nearest entry, ties to the lower index, and moves entries to floor(sum / count); unused ones stay.
    Repeated rows each count and each keep their row; rows without a label share one; an empty table gives an empty result. Components so large that
    squared distances of a part could leave 64 bits (at 8 numbers a part, some 46,000 and beyond before scaling by 4,096) are refused.

    The driver gets the first vectors and, each round, a sum and a count for each entry's component; a task holds one stretch of ``CHUNK`` vectors
    and those sums.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col(vector_col).isNotNull() & finite & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0))
    kept = kept.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    order = F.col("i").asc_nulls_last()
    first = kept.orderBy(order, "v").limit(1).first()
    id_type, label_type = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    if first is None:
        return spark.createDataFrame([], f"{id_col} {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.where(F.size("v") == len(first.v))
    least = [r.i for r in kept.select("i").distinct().orderBy(order).limit(entries).collect()]
    chosen = F.col("i").isin([x for x in least if x is not None]) | (F.col("i").isNull() if None in least else F.lit(False))
    seeds = [r.v for r in kept.where(chosen).groupBy("i").agg(F.min("v").alias("v")).orderBy(order).collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()

    schema = f"i array<{id_type}>, l array<{label_type}>, {TREE}"
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in spark.createDataFrame([], schema).schema])
    forest = materialize(kept.mapInArrow(_grow(parts, kinds), schema), "trees")
    for _ in range(rounds):
        # as many rows as the codebooks have numbers
        for r in forest.drop("i", "l").mapInArrow(_gather(books), SUMS).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r["at"]] = r.total // r.n
    named = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    coded = materialize(forest.mapInArrow(_encode(books), f"i {id_type}, l {label_type}, code string, error long"), "codes")
    release(forest)
    coded = coded.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("l").cast("string")), F.lit("-")))
    by_label = materialize(coded.groupBy("k").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return join_one(coded, by_label, "k", "n").select(F.col("i").alias(id_col), "code", "error", "label_error", F.lit(named).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, its rounds written out one after the other."""
    nearest = "SELECT v.vec_id, v.label, v.part, v.p, min_by(c.entry, list_sum(list_transform(range(1, len(v.p) + 1), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i]))) * 256 + c.entry) AS entry FROM v JOIN c{r} c USING (part) GROUP BY ALL"
    text = f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {scale}) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), v AS (
            SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS p FROM kept, range({parts}) t(part)
        ), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
        c0 AS MATERIALIZED (SELECT part, entry, p FROM v JOIN first USING (vec_id))"""
    for r in range(rounds):
        text += f""",
        a{r} AS MATERIALIZED ({nearest.format(r=r)}),
        s{r} AS (SELECT part, entry, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, len(p) + 1) t(i) GROUP BY ALL),
        m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM s{r} GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.p, c{r}.p) AS p FROM c{r} LEFT JOIN m{r} USING (part, entry))"""
    return text + f""",
        e AS MATERIALIZED ({nearest.format(r=rounds)}),
        d AS (
            SELECT vec_id, label, string_agg(lpad(lower(to_base(entry, 16)), 2, '0'), '' ORDER BY part) AS code,
                   sum(list_sum(list_transform(range(1, len(e.p) + 1), lambda i: (e.p[i] - c.p[i]) * (e.p[i] - c.p[i]))))::BIGINT AS error
            FROM e JOIN c{rounds} c USING (part, entry) GROUP BY ALL
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
        FROM d
    """

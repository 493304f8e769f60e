"""The dataset audit: duplicate components, leakage over splits, annotation conflicts, histograms and the gate."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.groups import whole_groups
from plumbline.functions.hashes import BANDS, COLOUR_GATE, bands, largest_difference
from plumbline.operators.components import connected_components
from plumbline.operators.skew import join_one
from plumbline.sources.scratch import materialize

EXAMPLES = 50  # fixed values: components and conflicts that a report names,
FILES = 1000  # and files of each; counts are of all
BLOCK = 1 << 14  # hashes of one value that are compared as one block
SMALL = 64  # rows of a group that is compared together with others
PAIRS = 1 << 16  # of a batch of results


def star_edges(records: DataFrame, *keys: str | Column, idx: str = "record_idx") -> DataFrame:
    """Edges (a, b) from the first record of each value of each key to its others.

    All keys share one pass. Firsts are pre-aggregated, and the rows of a hot value meet theirs without a shuffle. Null values join nothing.
    """
    values = F.array(*(F.struct(F.lit(i).alias("i"), (F.col(k) if isinstance(k, str) else k).cast("string").alias("v")) for i, k in enumerate(keys)))
    keyed = records.select(F.col(idx).alias("b"), F.explode(values).alias("k")).where("k.v is not null")
    first = materialize(keyed.groupBy("k").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1"), "firsts")
    return join_one(keyed, first, "k", "n").where("a <> b").select("a", "b")


def duplicate_pairs(records: DataFrame, key: str | Column) -> DataFrame:
    """One row: the sum over keys of their records less one (not all pairs of them)."""
    k = F.col(key) if isinstance(key, str) else key
    return records.groupBy(k.alias("k")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("pairs"))


def components(records: DataFrame, keys: list[str | Column], idx: str = "record_idx", more_edges: DataFrame | None = None) -> DataFrame:
    """``records`` with component_id, the least index that a record reaches over shared keys (and ``more_edges``)."""
    edges = star_edges(records, *keys, idx=idx)
    if more_edges is not None:
        edges = edges.unionByName(more_edges.select("a", "b"))
    roots = connected_components(edges).select(F.col("node").alias("_n"), "root")
    return records.join(roots, F.col(idx) == F.col("_n"), "left").withColumn("component_id", F.coalesce("root", idx)).drop("_n", "root")


def equal_bytes(nodes: int, threshold: int) -> int:
    """How many equal bytes are a key of the search among so many hashes: as many as make a value rare, but no more than two hashes within the threshold must share."""
    return min(max(BANDS - threshold, 1), max(1, math.ceil(math.log2(max(nodes, 2)) / 8)))


def close_in_groups(h: np.ndarray, at: np.ndarray, side: np.ndarray, threshold: int, most: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i before j, of hashes of one group that differ in at most ``threshold`` bits. ``at`` has the groups' first places and the end.

    Rows of side 0 are compared with each other, those of side 1 with those of side 2, which follow them. Small groups are compared together, each row with the
    next one, the one after it and so on; others row block by row block.
    """
    sizes = np.diff(at)
    ends = np.repeat(at[1:], sizes)
    found = []
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= most), sizes))
    step = 1
    while len(rows := rows[rows + step < ends[rows]]):
        for cut in range(0, len(rows), BLOCK * 16):
            i = rows[cut : cut + BLOCK * 16]
            hit = (np.bitwise_count(h[i] ^ h[i + step]) <= threshold) & ((side[i] == 0) | (side[i] != side[i + step]))
            found.append((i[hit], i[hit] + step))
        step += 1
    for g in np.flatnonzero(sizes > most):
        low, high = at[g], at[g + 1]
        middle = low + np.searchsorted(side[low:high], 2) if side[low] else None
        last = high if middle is None else middle
        for i in range(low, last, 64):
            till, first = min(i + 64, last), i + 1 if middle is None else middle
            x, y = np.nonzero(np.bitwise_count(h[i:till, None] ^ h[None, first:high]) <= threshold)
            hit = x + i < y + first
            found.append((x[hit] + i, y[hit] + first))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(2))


def _first_combo(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The place among ``chosen`` of the first combination of bytes that are all zero in each of ``x``."""
    zero = (x[:, None] >> (8 * np.arange(BANDS, dtype=np.uint64))) & np.uint64(255) == 0
    return np.argmax(zero[:, chosen].all(axis=2), axis=1)


def near_hashes(hashes: DataFrame, threshold: int, combos: list[tuple[int, ...]]) -> DataFrame:
    """Pairs (h_a, h_b) of the distinct ``hashes`` (h) that share the bytes of a combination and differ in at most ``threshold`` bits, each once, in no order.

    A task sorts the hashes of its combinations' values and compares them in numpy; the pair is taken at the first combination that it shares. A value that
    more than ``BLOCK`` hashes have is cut into blocks of about so many, each two of which are a group of their own, so no group is longer than two blocks or so.
    """
    byte = bands("h")
    # only a value all of whose bytes are frequent can be a long group: 2,048 counts tell which those are
    counted = hashes.select(F.posexplode(byte).alias("i", "v")).groupBy("i", "v").count().where(F.col("count") > BLOCK).collect()
    often = [[r.v for r in counted if r.i == i] for i in range(BANDS)]
    key = lambda combo: reduce(lambda x, i: F.shiftleft(x, 8).bitwiseOR(byte[i].cast("long")), combo, F.lit(0).cast("long"))
    hot = lambda combo: reduce(lambda x, i: x & byte[i].isin(often[i]), combo, F.lit(all(often[i] for i in combo)))
    each = F.array(*(F.struct(F.lit(k).alias("combo"), key(c).alias("value"), (hot(c) if all(often[i] for i in c) else F.lit(False)).alias("often")) for k, c in enumerate(combos)))
    keyed = hashes.select("h", F.explode(each).alias("k")).select("h", "k.*")
    plain = keyed.where("not often").select("combo", "value", F.lit(0).alias("cell"), F.lit(0).cast("byte").alias("side"), "h")
    if any(all(often[i] for i in c) for c in combos):
        heavy = keyed.where("often")
        sizes = heavy.groupBy("combo", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = heavy.join(sizes.hint("shuffle_hash"), ["combo", "value"]).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct((F.least("block", x) * F.col("blocks") + F.greatest("block", x)).alias("cell"), F.when(F.col("block") == x, 0).when(F.col("block") < x, 1).otherwise(2).cast("byte").alias("side")))
        plain = plain.unionByName(own.select("combo", "value", "h", F.explode(cells).alias("c")).select("combo", "value", "c.cell", "c.side", "h"))
    at = ["combo", "value", "cell"]
    together = plain.repartition(*at).sortWithinPartitions(*at, "side")
    chosen = np.array(combos)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, at):
            h = batch.column("h").to_numpy().view(np.uint64)
            i, j = close_in_groups(h, bounds, batch.column("side").to_numpy(), threshold)
            first = _first_combo(h[i] ^ h[j], chosen) == batch.column("combo").to_numpy()[i]
            i, j = i[first], j[first]
            for cut in range(0, len(i), PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(h[x[cut : cut + PAIRS]].view(np.int64)) for x in (i, j)], ["h_a", "h_b"])

    return together.mapInArrow(compare, "h_a long, h_b long")


def _near_nodes(records: DataFrame, threshold: int, idx: str, bits: str, colour: str | None) -> tuple[DataFrame, DataFrame]:
    """Nodes (hash, colour, node, n) of records with equal hash and colour, and the pairs (node_a, node_b) of near ones.

    Hashes that differ in ``threshold`` bits share ``BANDS - threshold`` bytes at least, or else, by the search's definition, one. Keys are combinations of so
    many equal bytes, or of fewer while these are rare enough among the hashes. With colours, nodes of near hashes and of one hash meet in a
    step of the first channel as wide as the gate, which one side takes with its neighbours. No side of a join is sent whole to all tasks.
    """
    c = [colour] if colour else []
    nodes = materialize(records.dropna(subset=[bits, *c]).groupBy(bits, *c).agg(F.min(idx).alias("node"), F.count("*").alias("n")), "hash-nodes")
    hashes = nodes.select(F.col(bits).alias("h"))
    hashes = materialize(hashes.distinct(), "hashes") if colour else hashes
    close = materialize(near_hashes(hashes, threshold, list(combinations(range(BANDS), equal_bytes(hashes.count(), threshold)))), "near-hashes")
    side = lambda x: nodes.select(F.col(bits).alias(f"h_{x}"), F.col("node").alias(f"node_{x}"), *(F.col(k).alias(f"m_{x}") for k in c))
    one, two = side("a").hint("merge"), side("b").hint("merge")
    if colour:
        step = lambda x: F.floor(F.col(f"m_{x}")[0] / COLOUR_GATE)
        several = materialize(nodes.groupBy(F.col(bits).alias("h_a")).count().where("count > 1").select("h_a"), "shared-hashes")
        to = close.unionByName(several.withColumn("h_b", F.col("h_a"))).join(one, "h_a").withColumn("step", F.explode(F.sequence(step("a") - 1, step("a") + 1)))
        met = to.join(two.withColumn("step", step("b")), ["h_b", "step"]).where(largest_difference("m_a", "m_b") <= COLOUR_GATE)
        met = met.where((F.col("h_a") != F.col("h_b")) | (F.col("node_a") < F.col("node_b")))
    else:
        met = close.join(one, "h_a").join(two, "h_b")
    return nodes, materialize(met.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b")), "near-nodes")


def near_pairs(records: DataFrame, threshold: int, idx: str = "record_idx", bits: str = "dhash", colour: str | None = "mean_rgb") -> DataFrame:
    """Pairs (a, b), a before b, that share a byte of their hash, differ in at most ``threshold`` bits, and pass the colour gate.

    Records with equal hash and colour are one node until the end, so a heap of alike images doesn't join with itself; their own pairs, and
    those with other nodes, are written out afterwards because the result is the pairs: m alike images give m (m - 1) / 2 rows, 100,000 of them 5e9. Who needs a number or components takes
    ``near_pair_count`` or ``near_edges``, which don't write them out.
    """
    c = [colour] if colour else []
    nodes, close = _near_nodes(records, threshold, idx, bits, colour)
    own = nodes.where("n > 1").select(F.col("node").alias("node_a"), F.col("node").alias("node_b"))
    members = records.join(nodes.drop("n").hint("merge"), [bits, *c]).select("node", F.col(idx).alias("i"))
    first, second = members.withColumnsRenamed({"node": "node_a", "i": "x"}), members.withColumnsRenamed({"node": "node_b", "i": "y"})
    pairs = close.unionByName(own).join(first.hint("merge"), "node_a").join(second.hint("merge"), "node_b").where((F.col("node_a") != F.col("node_b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_pair_count(records: DataFrame, threshold: int, idx: str = "record_idx", bits: str = "dhash", colour: str | None = "mean_rgb") -> DataFrame:
    """One row: how many pairs ``near_pairs`` has, from the sizes of nodes."""
    nodes, close = _near_nodes(records, threshold, idx, bits, colour)
    one, two = (nodes.select(F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    across = close.join(one.hint("merge"), "node_a").join(two.hint("merge"), "node_b").select((F.col("n_a") * F.col("n_b")).alias("n"))
    within = nodes.select(F.expr("n * (n - 1) div 2").alias("n"))
    return across.unionByName(within).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("near_pairs"))


def near_edges(records: DataFrame, threshold: int, idx: str = "record_idx", bits: str = "dhash", colour: str | None = "mean_rgb") -> DataFrame:
    """Edges (a, b) with the components of ``near_pairs``: those of near nodes, and of each node's first record to its others."""
    nodes, close = _near_nodes(records, threshold, idx, bits, colour)
    keys = [bits, colour] if colour else [bits]
    members = records.join(nodes.where("n > 1").drop("n"), keys).where(F.col(idx) != F.col("node"))
    return close.toDF("a", "b").unionByName(members.select(F.col("node").alias("a"), F.col(idx).alias("b")))


def duplicate_components(grouped: DataFrame) -> DataFrame:
    """One row: the number of components with more than one record."""
    return grouped.groupBy("component_id").count().where("count > 1").agg(F.count("*").alias("duplicate_components"))


def cross_split(records: DataFrame) -> DataFrame:
    """(component_id, n_records, splits) of components in more than one split; splits sorted and joined by commas."""
    seen = records.groupBy("component_id").agg(F.count("*").alias("n_records"), F.array_sort(F.collect_set("split")).alias("s"))
    return seen.where(F.size("s") > 1).select("component_id", "n_records", F.array_join("s", ",").alias("splits"))


def conflicts(records: DataFrame, key: str | Column, signature: str | Column) -> DataFrame:
    """(key, n_records, n_signatures) of exact duplicates that are annotated differently."""
    k, s = (F.col(x) if isinstance(x, str) else x for x in (key, signature))
    return records.groupBy(k.alias("key")).agg(F.count("*").alias("n_records"), F.count_distinct(s).alias("n_signatures")).where("n_signatures > 1")


def first_rows(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group in the given order. Each task keeps that many before groups are shuffled, so a hot group stays small."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def _with_files(groups: DataFrame, records: DataFrame, key: str, value: str, files: int, idx: str) -> DataFrame:
    """``groups`` with ``files``: the first values of the group's records in their order."""
    members = records.join(F.broadcast(groups.select(key)), key).select(key, idx, value)  # as many groups as a report has examples
    listed = first_rows(members, [key], [idx], files).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(idx, value))).alias("m"))
    return groups.join(listed.select(key, F.transform("m", lambda x: x[value]).alias("files")), key)


def cross_split_files(records: DataFrame, groups: int = EXAMPLES, files: int = FILES, idx: str = "record_idx", path: str = "image_path") -> DataFrame:
    """(component_id, n_records, splits, files) of the first components in more than one split, by their first record; files in record order, at most so many."""
    top = materialize(cross_split(records).orderBy("component_id").limit(groups), "crossing")
    return _with_files(top, records, "component_id", path, files, idx)


def conflict_files(records: DataFrame, key: str, signature: str, groups: int = EXAMPLES, files: int = FILES, idx: str = "record_idx", path: str = "label_path") -> DataFrame:
    """(key, first, n_records, files) of the first exact duplicates that are annotated differently, by their first record; files in record order, at most so many."""
    seen = records.groupBy(key).agg(F.min(idx).alias("first"), F.count("*").alias("n_records"), F.count_distinct(signature).alias("signatures")).where("signatures > 1").drop("signatures")
    return _with_files(materialize(seen.orderBy("first").limit(groups), "conflicting"), records, key, path, files, idx)


def gate(errors: DataFrame, crossing: DataFrame, conflicting: DataFrame) -> DataFrame:
    """One row of counts and ``safe``: no errors, nothing across splits, no conflicts. No records at all are safe."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(errors, "n_errors").join(count(crossing, "n_cross_split"), how="cross").join(count(conflicting, "n_conflicts"), how="cross")  # one row each
    return one.withColumn("safe", F.expr("n_errors = 0 and n_cross_split = 0 and n_conflicts = 0"))


def by_split(images: DataFrame, boxes: DataFrame, image: str) -> DataFrame:
    """(split, n_images, n_boxes, n_empty) of splits with an image; boxes without an image don't count."""
    per_image = images.join(boxes.groupBy(F.col(image).alias("_i")).agg(F.count("*").alias("n")), F.col(image) == F.col("_i"), "left")
    n = F.coalesce("n", F.lit(0))
    return per_image.groupBy("split").agg(F.count("*").alias("n_images"), F.sum(n).cast("long").alias("n_boxes"), F.count_if(n == 0).alias("n_empty"))


def by_class(boxes: DataFrame, classes: DataFrame, image: str) -> DataFrame:
    """(class_id, n_boxes, n_images) for every known class, zero where it has none."""
    per_image = boxes.groupBy("class_id", image).agg(F.count("*").alias("n"))
    seen = per_image.groupBy("class_id").agg(F.sum("n").alias("b"), F.count("*").alias("i"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return classes.join(seen, "class_id", "left").select("class_id", zero("b", "n_boxes"), zero("i", "n_images"))


def audit(records: DataFrame, boxes: DataFrame, classes: DataFrame, errors: DataFrame, near_threshold: int = 4, grouped: DataFrame | None = None) -> DataFrame:
    """The audit's one-row report over records (record_idx, split, image_path, sha256, parent_id, dhash, mean_rgb, signature); ``grouped`` are their components if known."""
    grouped = materialize(components(records, ["sha256", "parent_id"]), "components") if grouped is None else grouped
    crossing, conflicting = cross_split(grouped), conflicts(records, "sha256", "signature")
    multi = duplicate_components(grouped)
    near = near_pair_count(records, near_threshold) if near_threshold >= 0 else records.sparkSession.range(1).select(F.lit(0).cast("long").alias("near_pairs"))
    as_map = lambda df, k, v, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(name))
    splits, kinds = by_split(records, boxes, "record_idx"), by_class(boxes, classes, "record_idx")
    parts = [
        as_map(splits, "split", "n_images", "images_by_split"),
        as_map(splits, "split", "n_boxes", "boxes_by_split"),
        as_map(splits.where("n_empty > 0"), "split", "n_empty", "empty_by_split"),
        as_map(kinds, "class_id", "n_boxes", "boxes_by_class"),
        as_map(kinds, "class_id", "n_images", "images_by_class"),
        duplicate_pairs(records, "sha256").withColumnRenamed("pairs", "exact_pairs"),
        duplicate_pairs(records, "parent_id").withColumnRenamed("pairs", "parent_pairs"),
        near,
        multi,
        gate(errors, crossing, conflicting),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.join(part, how="cross")  # every part is one row
    return report

"""Near-duplicate groups by similarity of five-word shingles, for thresholds that are too wide for a 64-bit fingerprint alone.

SimHash goes first: fingerprints within two bits are linked by pigeonring chains, as in ``simhash``, and the links whose whole shingle sets are
similar enough join most of the nearest copies. Two texts at the threshold may be some twenty bits apart, where no chain tells them from strangers; what is
left is therefore found by prefix filtering: in any one order of all shingles two sets with a Jaccard similarity of ``LEAST`` or more share
one among the first few of each, so these are the keys of an equi-join between groups that aren't one yet. The order puts shingles that a
sample finds often last, which only saves work. Of candidates of either kind the 256-bit SimHashes are compared, then the whole sets: texts of
that similarity differ in some 39 bits, with a deviation of 6, so ``BITS_APART`` loses one in more than a thousand million: that comparison is the one step that isn't exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm._common import batched, forget, fresh, materialize, release, rows, short_batches, text_bytes
from plumbline.llm.simhash import shingle_hashes
from plumbline.operators.components import connected_components

LEAST = 800  # thousandths of Jaccard similarity
COMMON = 200_000  # shingles, at most, that are known to be frequent and come last in the order
LANES = 4  # of 64 bits in a SimHash
BITS_APART = 88  # differing bits of a SimHash beyond which whole sets aren't looked at
HELD = 500_000  # ids that are broadcast, at most
SALT = 512  # rows of a bucket that one task holds against all of it


def _rooted(held: DataFrame, roots: DataFrame) -> DataFrame:
    """``held`` with ``root``: the node's component, itself where it has no link."""
    found = roots.select(F.col("node").alias("member"), F.col("root").alias("found"))
    return held.join(found, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("found", "node")).drop("member", "found")


def _search(held: DataFrame, close: Callable[[DataFrame], DataFrame], may: Column, edges: DataFrame, most: int, outsiders: int) -> DataFrame:
    """``edges`` with more, so that the components are those of all pairs that share a bucket, ``may`` be close and are.

    ``held`` has (node, root, bucket, at), the root being that of ``edges``; ``may`` looks at ``at_a`` and ``at_b``, ``close`` takes distinct candidates
    (a, b). As only components count, pairs within one aren't tried. Of a bucket of up to ``most`` nodes all others are. In a fuller one each
    node is first tried with some hubs; then with all nodes of other components: first in buckets with up to ``outsiders`` nodes outside the largest
    component, then in all that are left.
    """
    hubs = [F.min("node"), F.max("node"), *(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(4))]
    load = held.groupBy("bucket").agg(F.count("*").alias("n"), F.array_distinct(F.array(*hubs)).alias("hubs"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("lo", "hi")
    shared = materialize(held.join(load, "bucket"), "shared-buckets")

    def tried(one: DataFrame, two: DataFrame, on: list[str], where: str) -> DataFrame:
        one = one.withColumnsRenamed({"node": "node_a", "at": "at_a", "root": "root_a"})
        two = two.withColumnsRenamed({"node": "node_b", "at": "at_b", "root": "root_b"})
        found = one.join(two, on).where(where).where("root_a <> root_b").where(may)
        return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()

    parts = ("bucket", "node", "root", "at")
    few, full = shared.where(F.col("n") <= most).select(*parts), shared.where(F.col("n") > most)
    first = tried(few, few, ["bucket"], "node_a < node_b")
    centres = full.where(F.array_contains("hubs", F.col("node"))).select(*parts)
    edges = edges.unionByName(close(first.unionByName(tried(full.select(*parts), centres, ["bucket"], "node_a <> node_b")).distinct()))
    if full.isEmpty():
        release(shared)
        return edges
    for limit in (outsiders, None):
        crowd = materialize(_rooted(full.drop("root", "hubs"), connected_components(edges)), "crowd")
        parts = crowd.groupBy("bucket", "root").agg(F.count("*").alias("m"))
        parts = parts.groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("main"), (F.sum("m") - F.max("m")).alias("outside")).where("outside > 0")
        whole, crowd = crowd, materialize(crowd.join(parts if limit is None else parts.where(F.col("outside") <= limit), "bucket"), "mixed-crowd")
        release(whole)
        salts = F.ceil(F.col("n") / SALT).cast("int")
        one = crowd.where("root <> main").select("bucket", "node", "at", "root", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
        two = crowd.select("bucket", "node", "at", "root", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        edges = edges.unionByName(close(tried(one, two, ["bucket", "salt"], "node_a <> node_b").distinct()))
        release(crowd)
    release(shared)
    return edges


def shingle_set(data: bytes, words: int = 5) -> np.ndarray:
    """The different shingle hashes of a text's bytes, ascending."""
    held = np.zeros(0, np.uint64)
    for hashes in shingle_hashes(data, words):
        held = np.union1d(held, hashes)
    return held


def prefix(held: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Those shingles of a set, rare ones first, of which every set of similarity ``LEAST`` or more has one among its own.

    ``common`` (ascending) are frequent shingles and ``often`` their counts; the order is by count, then by hash.
    """
    n = len(held)
    if not n:
        return held
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        count = np.where(common[at] == held, often[at], 0)
    return held[np.lexsort((held, count))[: n - -(-LEAST * n // 1000) + 1]]


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles met most often in a sixteenth of the different texts, a bounded number."""

    def run(batches):
        return batched(pa.schema([("h", pa.int64())]), ((h,) for (b,) in rows(batches, "data") for h in shingle_set(b, words).view(np.int64).tolist()))

    some = texts.where(F.pmod(F.xxhash64("data"), F.lit(16)) == 0).withColumn("mark", F.xxhash64("data")).dropDuplicates(["mark"]).select("data")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def wide_fingerprint(held: np.ndarray) -> list[int]:
    """The SimHash of a shingle set in ``LANES`` longs; the first one is that of the hashes themselves."""
    lanes = [held]
    for k in range(1, LANES):
        h = held + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        lanes.append(h ^ (h >> np.uint64(31)))
    return [simhash.of_hashes([h]) for h in lanes]


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) among nodes (node, fp): those of fingerprints within two bits, found by pigeonring chains, and those of one fingerprint by its least node."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    one, two = (least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")) for c in "ab")
    apart = simhash.links(least.select("fp")).join(one, "a").join(two, "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    same = nodes.join(least.where("n > 1").select("fp", "least"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return apart.unionByName(same)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, most: int = 32, outsiders: int = 8) -> DataFrame:
    """(id, group) for every row: the group is the smallest id of the near copies that a row reaches.

    Rows of equal shingle sets are one node, so exact copies make no pairs. Null and empty texts are copies of each other. Rows with equal ids
    are one document; null ids get no group. An empty table gives an empty result. Other columns are not looked at.
    """
    short_batches(docs.sparkSession)
    held = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(held, words))
    signs = pa.schema([("id", pa.int64()), ("sign", pa.binary()), ("size", pa.int64()), ("fp", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
    sets = pa.schema([("node", pa.int64()), ("sign", pa.binary()), ("held", pa.list_(pa.int32()))])
    sign = lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).digest()

    def keyed(batches):
        forget()

        def each():
            for i, b in rows(batches, "id", "data"):
                s = shingle_set(b, words)
                yield i, sign(s), len(s), wide_fingerprint(s), prefix(s, *frequent.value).view(np.int64)

        return batched(signs, each(), 512)

    def whole(batches):
        forget()
        # of a hash the higher half, which tells the shingles of two texts apart
        return batched(sets, ((i, sign(s), np.unique((s >> np.uint64(32)).astype(np.uint32).view(np.int32))) for i, b in rows(batches, "id", "data") for s in [shingle_set(b, words)]), 512)

    each = materialize(held.mapInArrow(keyed, "id long, sign binary, size long, fp array<long>, keys array<long>"), "signatures")
    own = [F.any_value(c).alias(c) for c in ("size", "fp", "keys")]
    nodes = materialize(each.where("id is not null").groupBy("sign").agg(F.min("id").alias("node"), *own), "signature-nodes")
    at = F.struct("size", (F.col("size") - F.col("pos")).alias("left"))
    keys = nodes.select("node", "size", F.posexplode("keys").alias("pos", "bucket")).select("node", "bucket", at.alias("at"))
    few = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    keys = materialize(keys.join(few, "bucket", "left_semi"), "shared-keys")
    # what two sets share is at most what is left of the smaller from their first shared shingle on
    may = F.least("at_a.left", "at_b.left") * (1000 + LEAST) >= LEAST * (F.col("at_a.size") + F.col("at_b.size"))
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)

    def close(pairs: DataFrame) -> DataFrame:
        one, two = (nodes.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "ab")
        alike = materialize(pairs.join(one, "a").join(two, "b").where(apart <= BITS_APART).select("a", "b").distinct(), "alike")
        wanted = materialize(alike.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        n = wanted.count()
        if not n:
            return alike
        texts = held.join(F.broadcast(wanted) if n <= HELD else wanted, "id", "left_semi")
        full = materialize(texts.mapInArrow(whole, "node long, sign binary, held array<int>").dropDuplicates(["node", "sign"]).select("node", "held"), "shingle-sets")
        one, two = (full.select(F.col("node").alias(c), F.col("held").alias(f"held_{c}")) for c in "ab")
        both = F.size(F.array_intersect("held_a", "held_b")).cast("long")
        found = alike.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("held_a") + F.size("held_b")).alias("sum"))
        near = materialize(found.where(F.col("both") * 1000 >= LEAST * (F.col("sum") - F.col("both"))).select("a", "b").distinct(), "near-nodes")
        release(alike, wanted, full)
        return near

    edges = close(_by_fingerprint(nodes.select("node", F.col("fp")[0].alias("fp"))))
    known = materialize(_rooted(keys, connected_components(edges)), "rooted-keys")
    release(keys)
    roots = connected_components(_search(known, close, may, edges, most, outsiders))
    named = _rooted(nodes.select("sign", "node"), roots).select(F.col("sign").alias("s"), F.col("root").alias("group"))
    out = each.select("id", "sign").join(named, F.col("sign") == F.col("s"), "left").select("id", F.when(F.col("id").isNotNull(), F.col("group")).alias("group"))
    out = materialize(out, "groups")
    release(each, nodes, known)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is that of their group, the smallest; rows with null ids stay.

    Of rows with null and empty texts, which are copies of each other, the first stays; rows with equal ids stay or go together; an empty table stays
    empty; no name of another column clashes. What goes is a table of ids, written, so its size is known: it is broadcast where it is small, else joined.
    """
    name = fresh("gone", docs.columns)
    gone = materialize(groups(docs, id_col, text_col, words).where(F.col("id") != F.col("group")).select(F.col("id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")

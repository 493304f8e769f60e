"""Connected components of an edge table, without driver-side collection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import join_one
from plumbline.sources.scratch import materialize, release

FINISH = 500_000  # edges that one task may join: some hundred bytes each
NODES = 500_000  # that a task holds at a time while it joins the edges of its partition


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Rows (node, root): every node that has an edge to a smaller one, with the smallest node it can reach.

    Before anything is shuffled, tasks join the edges that they have by union-find and pass on a star for each set. While more than ``FINISH`` edges are
    left, a large-star and a small-star step hook neighbours onto the smallest node, and nodes that only one edge is left of are solved:
    they take that edge out of the graph, and their root is looked up when all else is known. What is left at last is joined in one task. A node
    with very many edges isn't shuffled with them: its minimum is summed up beforehand and broadcast to them. Steps end in
    tables in the shared folder, which are removed when they aren't needed any more.
    Self loops and repeated edges are dropped; nulls are ignored; an empty table gives an empty table.
    """
    kind = edges.schema[a].dataType.simpleString()
    schema = f"u {kind}, v {kind}"

    def joined(df: DataFrame, most: int | None) -> DataFrame:
        return df.mapInArrow(lambda batches: _stars(batches, most), schema)

    cur = materialize(joined(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), NODES).distinct(), "edges")
    solved = []
    while (n := cur.count()) > FINISH:
        if len(solved) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds: {n} edges are left")
        # large star: larger neighbours go to the smallest one
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "least")
        large = join_one(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(joined(large, NODES).distinct(), "edges")
        # small star: smaller ones too
        under = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        hooked = join_one(large, under, "u", "n")
        small = hooked.select("u", F.col("m").alias("v")).unionByName(hooked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = materialize(joined(small, NODES).distinct(), "edges")
        release(cur, least, large, under)
        # nodes of one edge go
        ends = materialize(small.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("n")), "degrees")
        held = materialize(join_one(small, ends, "u", "n").select("u", "v", (F.col("n") == 1).alias("last")), "edges")
        release(small, ends)
        solved.append(held)
        cur = held.where(~F.col("last")).select("u", "v")
    roots = materialize(joined(cur.repartition(1), None), "roots")
    for held in reversed(solved):
        # the root of what a solved node hangs on, a row a node, and how many hang there
        on = held.where("last").groupBy("v").agg(F.count("*").alias("n"))
        on = materialize(on.join(roots.toDF("_u", "root"), F.col("v") == F.col("_u"), "left").select("v", "n", F.coalesce("root", "v").alias("root")), "hung")
        found = join_one(held.where("last").select("u", "v"), on, "v", "n").select("u", F.col("root").alias("v"))
        more = materialize(roots.unionByName(found), "roots")
        release(roots, on, held)
        roots = more
    if not solved:
        release(cur)
    return roots.toDF("node", "root")


def _stars(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from each node to the smallest one of its set, of the edges read; after ``most`` nodes it begins anew."""
    parent: dict = {}

    def top(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if top(x) != x]
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([top(x) for x in part], kind)], ["u", "v"])
        parent.clear()

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                a, b = (a, b) if a < b else (b, a)
                parent[b] = a
        if most and len(parent) >= most:
            yield from stars()
    if parent:
        yield from stars()

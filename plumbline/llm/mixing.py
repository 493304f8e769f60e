"""Mixing sources to target weights, with DataFrame operations only.

Every source's rows are hashed into blocks. A source's target, in words, is turned into an exact quota of block draws: whole passes
over its blocks, then a prefix of its permuted blocks, the last one given in part; a source of few rows is given row by row, by
an exact sum. A splitting tree deals these quotas out: each node
halves its range of shards, and the left half gets from each source a multivariate-hypergeometric share, drawn conditionally source
by source. A leaf is a shard with its exact quota of each source; shards draw disjoint stretches of the permuted blocks, and rows of
a shard are ordered by a hash. All randomness is hashes of a seed, so reruns agree and a lost task is computed again alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._common import materialize

WEIGHTS = (5, 2, 1)
NEAR = 0.002  # of a target: what a cut block may leave open without further tries
STARTS = 48  # those tries
FEW = 12  # rows of a source that is filled exactly, from none of its words to all that may be taken


def word_count(text: str | Column) -> Column:
    """The number of maximal runs of other characters than blank and \\x09-\\x0D; null counts zero."""
    return F.regexp_count(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Add ``rank``, ``weight`` and ``target`` to rows (source, words), one for each source.

    Sources are ranked by code point, null last, and take the weights in turn. Targets share the sum of all words by weight; none
    exceeds ``cap`` times its source's words, and what it would exceed is shared again by weight. In the order of cap over weight the
    capped sources are a prefix, and the common level of the rest is the highest that any prefix leaves.
    The table has one row a source; it is the only one that is ordered as a whole.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("words") * float(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    spent = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.sum("words").over(everything) - spent) / left)
    ranked = ranked.withColumn("top", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.col("weight") * F.col("top"))
    return ranked.withColumn("target", target).drop("cap", "ratio", "level", "top")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (rank, shard, quota) that deal rows (rank, draws) out among shards, all draws and no more.

    One row stands for a node; its array has the quota of each source. Of a node's draws the left half of its shards gets its exact
    proportion. Each source's draws fall to the left one by one with probability (left places open)/(draws not yet dealt), which
    makes the counts multivariate hypergeometric.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("draws").cast("long").alias("n")))).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    open_, done = nodes.where("hi - lo > 1"), nodes.where("hi - lo = 1")
    while shards > 1:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.n)
        cut = open_.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")).withColumn("total", total)
        share = F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo")) + _unit(F.lit(seed), F.col("lo"), F.col("hi")))
        cut = cut.withColumn("left", F.least(F.col("total"), share.cast("long")))

        def deal(state: Column, x: Column) -> Column:
            """Deal one source's draws: (places left of the node's cut, draws to come, the lefts so far)."""
            none = F.struct(state.open.alias("open"), state.todo.alias("todo"), F.lit(0).cast("long").alias("got"))
            one = F.aggregate(
                F.when(x.n > 0, F.sequence(F.lit(1).cast("long"), x.n)).otherwise(F.array().cast("array<long>")),
                none,
                lambda s, i: F.when(
                    _unit(F.lit(seed), F.col("lo"), F.col("hi"), x["rank"], i) * s.todo < s.open,
                    F.struct((s.open - 1).alias("open"), (s.todo - 1).alias("todo"), (s.got + 1).alias("got")),
                ).otherwise(F.struct(s.open.alias("open"), (s.todo - 1).alias("todo"), s.got.alias("got"))),
            )
            return F.struct(one.open.alias("open"), one.todo.alias("todo"), F.concat(state.lefts, F.array(F.struct(x["rank"].alias("rank"), one.got.alias("n")))).alias("lefts"))

        start = F.struct(F.col("left").alias("open"), F.col("total").alias("todo"), F.array().cast("array<struct<rank:int,n:bigint>>").alias("lefts"))
        cut = cut.withColumn("lefts", F.aggregate("q", start, deal, lambda s: s.lefts))
        rights = F.zip_with("q", "lefts", lambda a, b: F.struct(a["rank"].alias("rank"), (a.n - b.n).alias("n")))
        halves = F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("lefts").alias("q")), F.struct(F.col("mid").alias("lo"), "hi", rights.alias("q")))
        nodes = cut.select(F.explode(halves).alias("h")).select("h.*")
        nodes = materialize(nodes, "quota-tree")  # a level's draws are used by both of its halves
        done = done.unionByName(nodes.where("hi - lo = 1"))
        open_ = nodes.where("hi - lo > 1")
        if open_.isEmpty():
            break
    return done.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("x.rank", "shard", F.col("x.n").alias("quota"))


def _exact_fill() -> Column:
    """The (mark, size) of few rows ``g``, each up to ``spare`` times, whose words come as near to ``rest`` from below as any such choice does.

    Row after row the sums that can be reached are listed; from the best of the last list the way back tells how often each row is in it. Rows
    without words are taken once.
    """
    nothing = F.array().cast("array<struct<mark:bigint,size:bigint>>")
    draw = lambda x, k: F.array_repeat(F.struct(x.mark.alias("mark"), x["size"].alias("size")), k.cast("int"))
    times = F.sequence(F.lit(0), F.col("spare"))

    def solved(rows: Column) -> Column:
        reach = lambda sums, x: F.array_distinct(F.filter(F.flatten(F.transform(sums, lambda s: F.transform(times, lambda k: s + k * x.all))), lambda s: s <= F.col("rest")))
        lists = F.aggregate(rows, F.array(F.array(F.lit(0).cast("long"))), lambda found, x: F.concat(found, F.array(reach(F.element_at(found, -1), x))))

        def back(found: Column) -> Column:
            start = F.struct(F.array_max(F.element_at(found, -1)).alias("sum"), nothing.alias("took"))

            def step(state: Column, i: Column) -> Column:
                x = F.element_at(rows, i)
                k = F.filter(times, lambda k: F.array_contains(F.element_at(found, i), state["sum"] - k * x.all))[0]
                return F.struct((state["sum"] - k * x.all).alias("sum"), F.concat(state.took, draw(x, k)).alias("took"))

            return F.aggregate(F.sequence(F.size(rows), F.lit(1), F.lit(-1)), start, step).took

        return F.transform(F.array(lists), back)[0]  # of one element each, so that lists are made once

    with_words, without = F.filter("g", lambda x: x.all > 0), F.flatten(F.transform(F.filter("g", lambda x: x.all == 0), lambda x: draw(x, F.lit(1))))
    return F.concat(without, F.when(F.size(with_words) > 0, F.transform(F.array(with_words), solved)[0]).otherwise(nothing))


def _fill() -> Column:
    """What a cut block gives: the (mark, size) of rows whose words come near ``rest``, none more than ``spare`` times; of a source of ``few`` rows the best choice.

    Rows ``g`` (mark, size, all) are taken in the order of their marks if they fit, then again, the longest first, while there are copies to spare.
    If more than ``NEAR`` of the goal is still open, the block is filled anew with the longest rows first, from each of ``STARTS``
    rows on, all rows in turn or each as often as it fits, and what leaves least is taken. A block's rows are few, whatever the table's size.
    """
    nothing = F.array().cast("array<struct<mark:bigint,size:bigint>>")
    longest = F.filter(F.array_sort("g", lambda a, b: F.when(a.all != b.all, F.signum(b.all - a.all).cast("int")).otherwise(F.signum(b.mark.cast("double") - a.mark.cast("double")).cast("int"))), lambda x: x.all > 0)

    def first_fit(order: Column) -> Column:
        start = F.struct(F.col("rest").cast("double").alias("left"), nothing.alias("took"))
        take = lambda s, x: F.struct((s.left - x.all).alias("left"), F.concat(s.took, F.array(F.struct(x.mark.alias("mark"), x["size"].alias("size")))).alias("took"))
        return F.aggregate(order, start, lambda s, x: F.when(x.all <= s.left, take(s, x)).otherwise(s))

    again = F.flatten(F.array_repeat(longest, F.col("spare") - 1))
    rounds, heaps = F.flatten(F.array_repeat(longest, F.col("spare"))), F.flatten(F.transform(longest, lambda x: F.array_repeat(x, F.col("spare"))))
    by_mark = first_fit(F.concat("g", again))
    starts = F.sequence(F.lit(1), F.least(F.lit(STARTS), F.greatest(F.size(longest), F.lit(1))))
    least = lambda every: F.array_min(F.transform(starts, lambda i: first_fit(F.slice(every, i, F.greatest(F.size(every), F.lit(1))))))
    return F.when(F.col("few"), _exact_fill()).when(by_mark.left <= F.col("goal") * NEAR, by_mark.took).otherwise(F.least(by_mark, least(rounds), least(heaps)).took)


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, shards: int = 16, block_rows: int = 1000, seed: int = 17) -> DataFrame:
    """One row a block: (source, block, n_blocks, source_size, target, passes, extra, fill, place, bounds).

    ``rows`` has (source, size, mark), the mark a hash that orders rows. A row of the block is drawn ``passes`` times, and once
    more if ``extra`` is 1 and ``fill`` null. Where a source's last block is cut, ``fill`` has the (mark, size) of its rows that are drawn
    once more, of some several times. ``place`` is the block's place in the permutation of its source's
    blocks; ``bounds`` has, for each shard, where its stretch of the source's draws ends.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = materialize(targets(sources, weights, cap).withColumn("n_blocks", F.ceil(F.col("n") / block_rows).cast("long")), "sources")
    placed = rows.join(sources.select(F.col("source").alias("s"), "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.expr("pmod(mark, n_blocks)"))
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("size"))
    few = (F.col("n_blocks") == 1) & (F.col("n") <= FEW)
    known = sources.select(F.col("source").alias("s"), "rank", "words", "target", "n_blocks", few.alias("few"))
    blocks = blocks.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "block")
    blocks = blocks.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passes = F.when((F.col("words") > 0) & ~F.col("few"), F.floor(F.col("target") / F.col("words"))).otherwise(0)
    blocks = blocks.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("words") - F.col("before"))
    blocks = materialize(blocks.withColumn("extra", F.when(F.col("rest") > 0, 1).otherwise(0)), "blocks")

    split = blocks.where("rest > 0 and (size > rest or few)").select("few", F.col("source").alias("s"), F.col("block").alias("b"), "rest", "n_blocks", F.col("target").alias("goal"), (F.lit(cap) - F.col("passes")).cast("int").alias("spare"))
    inside = rows.join(split, F.col("source").eqNullSafe(F.col("s")) & (F.expr("pmod(mark, n_blocks)") == F.col("b")))
    at = ["s", "b", "rest", "goal", "spare", "few"]
    groups = inside.groupBy(*at, "mark", "size").agg(F.sum("size").alias("all"))  # equal ids stay together
    held = groups.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("mark", "size", "all"))).alias("g"))
    cuts = held.select("s", "b", _fill().alias("fill"))
    blocks = blocks.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    blocks = materialize(blocks, "cut-blocks")

    draws = blocks.groupBy("rank").agg(F.sum(F.col("passes") + F.col("extra")).alias("draws"))
    quotas = split_quotas(draws, shards, seed)
    ends = quotas.withColumn("end", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")))
    bounds = ends.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("b")).select(F.col("rank").alias("r"), F.transform("b", lambda x: x.end).alias("bounds"))
    return materialize(blocks.join(bounds, F.col("rank") == F.col("r")).select("source", "block", "n_blocks", F.col("words").alias("source_size"), "target", "passes", "extra", "fill", "place", "bounds"), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, shards: int = 16, block_rows: int = 1000, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` in the struct ``doc``, with (size, source_size, target, draws).

    ``draws`` has an element (shard, pass, place) for each time that the mix takes the row: at most ``cap``. Ordering a shard by
    ``place`` gives its shuffled rows; ``rows_of_mix`` does so. A row's size is its number of words unless ``size`` is given; null
    texts have size zero; null sources form one source, ranked last; equal ids share a mark and are drawn together; an
    empty table gives an empty result. Taken words of a source never exceed its target; what they
    miss is less than the shortest row of its cut block that could be drawn once more, and of a source of ``FEW`` rows or less no choice misses less.
    """
    measured = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), (size if size is not None else word_count(text_col)).alias("size"))
    measured = measured.withColumn("mark", F.xxhash64(F.lit(seed), F.col("id")))
    narrow = materialize(measured.select("source", "size", "mark"), "sizes")
    table = plan(narrow, weights, cap, shards, block_rows, seed)
    per_source = table.select(F.col("source").alias("s"), "n_blocks").distinct()
    placed = measured.join(per_source, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.expr("pmod(mark, n_blocks)")).drop("s", "n_blocks")
    own = table.withColumnsRenamed({"source": "s", "block": "b"})
    full = placed.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    more = F.size(F.filter("fill", lambda x: (x.mark == F.col("mark")) & (x["size"] == F.col("size"))))
    copies = F.col("passes") + F.when(F.col("fill").isNull(), F.col("extra")).otherwise(more)

    def draw(k: Column) -> Column:
        at = F.least(k, F.col("passes")) * F.col("n_blocks") + F.col("place")
        shard = F.size(F.filter("bounds", lambda end: end <= at))
        return F.struct(shard.alias("shard"), k.cast("int").alias("pass"), F.xxhash64(F.lit(seed + 1), F.col("mark"), k).alias("place"))

    draws = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), draw)).otherwise(F.array())
    return full.select("doc", "size", "source_size", "target", draws.alias("draws"))


def rows_of_mix(mixed: DataFrame, shards: int = 16) -> DataFrame:
    """The mix itself: the document's columns, once a draw, each shard a partition of its own and shuffled within it.

    Rows without a draw, such as those of sources whose target is zero, don't come; repeated rows come with their own draws; nulls are kept as they are; an
    empty table gives an empty result. The document is a struct until the end, so no column's name clashes.
    """
    drawn = mixed.select("doc", F.explode("draws").alias("draw")).select("doc", "draw.shard", "draw.place")
    return drawn.repartitionById(shards, F.col("shard")).sortWithinPartitions("place").select("doc.*")

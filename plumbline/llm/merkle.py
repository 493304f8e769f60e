"""A Merkle manifest of documents: a tree of digests for each source, one over the sources, and a proof for each document.

A document's place in its source is its rank by id. Ranks come without a sort of everything: documents are counted by prefixes of their
ids' digits, prefixes that hold too many by longer ones, and the counts before a prefix, summed from the shortest to the longest, give each
small bucket of documents its first rank. The nodes of a tree form a trie over the digits of the rank in the base of the tree's
fanout: ranks that share all but their last ``TIER`` digits are a block. A block's levels are reduced in one row, its top takes part in the block of the
next longer prefix, and once the root is known the ways to it come down the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.llm._common import materialize, release
from plumbline.operators.ordering import global_index
from plumbline.operators.skew import join_one

FANOUT = 3
TIER = 6  # levels of a block, which has at most FANOUT ** TIER leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ID_DIGITS = 17  # of a row's key: whether it has an id, and sixteen hex digits of it; the leaf's digest follows
STEP = 3  # hex digits by which a prefix grows
START = ID_DIGITS - STEP  # a bucket holds the ids that share so many digits,
MOST = 4096  # unless these are more rows than this
WAY = "array<struct<before:string,after:string>>"  # the siblings at each level, those of a run put together


def digest(value: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _tree_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, source, doc_id, key, leaf, altered, n), a row for each distinct leaf of a source and id, ``n`` documents of which are equal.

    ``key`` sorts as the rows do: null ids first, then by id, equal ids by their leaf. ``altered`` is the leaf of the text without its line feeds where the
    CRC-32 of the id's decimal digits is even and that differs, else null.
    """
    head = F.concat(*(field(F.col(f)) for f in FIELDS[:-1]))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even & F.contains("text", F.lit("\n")), digest(F.concat(head, field(F.replace("text", F.lit("\n"), F.lit(""))))))
    each = docs.select("source", "doc_id", digest(F.concat(head, field(F.col("text")))).alias("leaf"), altered.alias("altered"))
    each = each.groupBy("source", "doc_id", "leaf").agg(F.min("altered").alias("altered"), F.count("*").alias("n"))
    # a signed number's hex digits sort by value once its sign bit is turned
    digits = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    number = F.coalesce(F.concat(F.lit("1"), digits), F.lit("0" * ID_DIGITS))
    return each.select(_tree_key(F.col("source")).alias("tree"), "source", "doc_id", F.concat(number, "leaf").alias("key"), "leaf", "altered", "n")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, key, n, ...) with ``first``, how many of its tree's documents come before the row's, and ``total``, how many the tree has.

    ``rows`` should be a written table whose keys are distinct in a tree. Windows span a bucket of at most ``MOST`` rows, or a prefix's
    continuations by ``STEP`` digits, of which there are ``16 ** STEP`` at most.
    """
    ends = rows.agg(F.min("key"), F.max("key")).first()
    if ends[0] is None:
        return rows.select("*", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("total"))
    common = next((i for i, (a, b) in enumerate(zip(*ends, strict=True)) if a != b), len(ends[0]))
    in_buckets = rows.withColumn("bucket", F.left("key", F.lit(START)))
    count = lambda df: materialize(df.groupBy("tree", "bucket").agg(F.sum("n").alias("w"), F.count("*").alias("c")), "id-digits")
    counted, length = [count(in_buckets)], START
    while not (over := counted[-1].where(F.col("c") > MOST)).isEmpty():
        # the buckets that hold too many rows get longer names, and so on; keys are distinct, so this ends
        length += STEP
        name = lambda df: df.select("*", F.concat("bucket", "tree").alias("at"))  # noqa: E731, B023
        over = materialize(name(over).select("at", "c"), "full-buckets")
        split = join_one(name(in_buckets), over.withColumn("more", F.lit(True)), "at", "c", how="left")
        in_buckets = materialize(split.withColumn("bucket", F.when(F.col("more"), F.left("key", F.lit(length))).otherwise(F.col("bucket"))).drop("at", "c", "more"), "buckets")
        counted[-1] = counted[-1].where(F.col("c") <= MOST)
        counted.append(count(in_buckets.where(F.length("bucket") == length)))
    # counts of each prefix, the longest first
    sums, lengths = {}, range(length, min(common, START - 1), -STEP)
    for i, at in enumerate(lengths):
        found = counted[-1 - i].select("tree", "bucket", "w") if i < len(counted) else None
        if i:
            above = sums[lengths[i - 1]].groupBy("tree", F.left("bucket", F.lit(at)).alias("bucket")).agg(F.sum("w").alias("w"))
            found = above if found is None else found.unionByName(above)
        sums[at] = materialize(found, "prefix-counts") if i else found
    # what comes before each, the shortest first
    known, starts = None, None
    for at in reversed(lengths):
        before = Window.partitionBy("tree", "parent").orderBy("bucket")
        each = sums[at].withColumn("parent", F.left("bucket", F.lit(max(at - STEP, common) if known is None else at - STEP)))
        each = each.withColumn("first", F.coalesce(F.sum("w").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if known is None:
            each = each.withColumn("total", F.sum("w").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        else:
            up = known.select("tree", F.col("bucket").alias("parent"), F.col("first").alias("base"), "total")
            each = each.join(up, ["tree", "parent"]).withColumn("first", F.col("first") + F.col("base"))
        known = each.select("tree", "bucket", "first", "total")
        starts = known if starts is None else starts.unionByName(known)
    starts = materialize(starts.withColumnRenamed("first", "base"), "first-ranks")
    inside = Window.partitionBy("tree", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = in_buckets.join(starts, ["tree", "bucket"])
    return placed.withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("bucket", "base")


def _height(total: Column) -> Column:
    """How many levels a tree with so many leaves has above them."""
    powers = F.array(*(F.lit(FANOUT**k).cast("long") for k in range(40)))  # up to 3^39, the last below 2^63
    return F.size(F.filter(powers, lambda p: p < total))


def _levels(blocks: DataFrame, tier: int) -> DataFrame:
    """``blocks`` (total, l0, ...) with the levels l1 to l``TIER`` above the digests l0, and ``steps``, how many of them count."""
    steps = F.least(F.lit(TIER), F.greatest(F.lit(0), _height(F.col("total")) - tier * TIER))
    out = blocks.withColumn("steps", steps)
    for k in range(TIER):
        low = F.col(f"l{k}")
        get = lambda q, i, low=low: F.coalesce(F.get(low, q * FANOUT + i), F.lit(""))
        up = F.transform(F.sequence(F.lit(0), F.floor((F.size(low) - 1) / FANOUT).cast("int")), lambda q: digest(F.concat(*(get(q, i) for i in range(FANOUT)))))
        out = out.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, up).otherwise(low))
    return out


def _way(i: Column) -> Column:
    """The siblings of the block's i-th digest and of those above it: an array of (before, after), digests of a run put together."""

    def step(k: int) -> Column:
        low, own = F.col(f"l{k}"), F.floor(i / FANOUT**k).cast("int")
        run = F.floor(i / FANOUT ** (k + 1)).cast("int") * FANOUT
        piece = lambda j: F.coalesce(F.get(low, run + j), F.lit(""))
        before = F.concat(*(F.when(run + j < own, piece(j)).otherwise("") for j in range(FANOUT)))
        after = F.concat(*(F.when(run + j > own, piece(j)).otherwise("") for j in range(FANOUT)))
        return F.struct(before.alias("before"), after.alias("after"))

    return F.slice(F.array(*(step(k) for k in range(TIER))), 1, F.col("steps"))


def _grouped(nodes: DataFrame, tier: int) -> DataFrame:
    """Blocks (tree, total, block, l0 ...) of nodes (tree, total, pos, digest), with their levels; written."""
    held = nodes.groupBy("tree", "total", F.floor(F.col("pos") / FANOUT**TIER).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("m"))
    return materialize(_levels(held.select("tree", "total", "block", F.transform("m", lambda x: x.digest).alias("l0")), tier), "blocks")


def _tops(blocks: DataFrame) -> DataFrame:
    return blocks.select("tree", "total", F.col("block").alias("pos"), F.col(f"l{TIER}")[0].alias("digest"))


def _climb(nodes: DataFrame, most: int, tier: int = 0) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks above nodes, and the nodes (tree, digest) that remain. ``most`` is the size of the largest tree in nodes of this tier."""
    tiers = []
    while most > 1:
        tiers.append(_grouped(nodes, tier))
        nodes, most, tier = _tops(tiers[-1]), -(-most // FANOUT**TIER), tier + 1
    return tiers, nodes.select("tree", "digest")


def _descend(tiers: list[DataFrame], ways: DataFrame) -> DataFrame:
    """(tree, pos, way, *more): the ways to the root of the lowest tier's nodes, from ``ways`` (tree, way, *more), those of trees' tops."""
    more = [c for c in ways.columns if c not in ("tree", "pos", "way")]
    ways = ways.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        held = blocks.join(ways.withColumnRenamed("pos", "block"), ["tree", "block"])
        each = F.transform(F.sequence(F.lit(0), F.size("l0") - 1), lambda i: F.struct((F.col("block") * FANOUT**TIER + i).alias("pos"), F.concat(_way(i), F.col("way")).alias("way")))
        ways = held.select("tree", *more, F.explode(each).alias("x")).select("tree", "x.pos", "x.way", *more)
    return ways


def fold(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(way, leaf, lambda x, s: digest(F.concat(s.before, x, s.after)))


def proof(way: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(way, lambda s: F.concat(s.before, s.after)), ""))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of ``docs``; other columns than ``FIELDS`` are passed over.

    Null fields have a form of their own; rows without an id come first in their source and are never tampered with; rows without a source form one,
    the first. Equal ids are ordered by their leaf; equal rows have a place and a proof each. An empty table gives an empty result; texts
    may be of any length. A lone leaf is its source's subroot, a lone subroot the root, and without siblings the proof is the digest of nothing.

    What is shuffled are ids and digests, not texts. Equal rows are summed up first, so a heap of copies is one row until blocks are
    filled, and an id, or no id, that many rows have is told apart by their digests' digits.
    """
    held = materialize(leaves(docs), "leaves")
    placed = ranked(held)
    size = FANOUT**TIER
    # the blocks that a row's places are in: heaps of equal rows are cut twice, so that no array is long
    lo, hi = F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("n") - 1) / size)
    held_by = placed.withColumns({"lo": lo, "hi": hi}).withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    block = F.explode(F.sequence(F.greatest("lo", F.col("part") * size), F.least("hi", F.col("part") * size + size - 1))).alias("block")
    parts = held_by.select("tree", "total", "first", "n", "doc_id", "leaf", "altered", block)
    row = F.struct("first", "n", "doc_id", "leaf", "altered")
    blocks = parts.groupBy("tree", "total", "block").agg(F.array_sort(F.collect_list(row)).alias("m"))
    inside = lambda x: F.least(x["first"] + x["n"], (F.col("block") + 1) * size) - F.greatest(x["first"], F.col("block") * size)
    rows = F.flatten(F.transform("m", lambda x: F.array_repeat(F.struct(x.doc_id.alias("doc_id"), x.leaf.alias("leaf"), x.altered.alias("altered")), inside(x).cast("int"))))
    blocks = blocks.select("tree", "total", "block", rows.alias("rows")).withColumn("l0", F.transform("rows", lambda x: x.leaf))
    blocks = materialize(_levels(blocks, 0), "leaf-blocks")

    largest = blocks.agg(F.max("total")).first()[0] or 0
    tiers, tops = _climb(_tops(blocks), -(-largest // FANOUT**TIER), 1)
    sources = held.select("tree", "source").distinct().join(tops, "tree")
    at = global_index(sources, F.col("source").asc_nulls_first(), name="pos")  # a row a source
    n_sources = at.count()
    nodes = materialize(at.select(F.lit("").alias("tree"), F.lit(n_sources).cast("long").alias("total"), "pos", "digest"), "subroots")
    upper, top = _climb(nodes, n_sources)
    found = top.first()
    root = F.lit(found.digest if found else None).cast("string")  # one digest
    start = top.select("tree", F.from_json(F.lit("[]"), WAY).alias("way"))
    of_source = _descend(upper, start).select("pos", "way")
    ways = materialize(at.select(F.col("tree"), "pos", F.col("digest").alias("subroot")).join(of_source, "pos").drop("pos"), "source-ways")
    of_block = _descend(tiers, ways).withColumnRenamed("pos", "block")
    each = F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: F.struct(F.get("rows", i).alias("row"), _way(i).alias("own")))
    out = blocks.join(of_block, ["tree", "block"]).select("subroot", "way", F.explode(each).alias("x")).select("x.row.*", "subroot", F.concat("x.own", "way").alias("way"))
    folded = out.select("doc_id", "leaf", "subroot", root.alias("root"), proof(F.col("way")).alias("proof_sha256"), fold(F.coalesce("altered", "leaf"), F.col("way")).alias("folded_root"))
    release(held)
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 18, source_levels: int = 9) -> str:
    """The same in SQL, level after level: enough for sources of 3^18 documents, and 3^9 sources."""
    field_sql = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field_sql(f) for f in FIELDS[:-1])
    # CRC-32 bit by bit: a byte is mixed in, then eight shifts, marked -1; the result's last bit is still to be turned
    steps = f"flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT{', -1' * 8}]))"
    odd = f"list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) & 1"

    def climb(name: str, n: int) -> str:
        """Runs and levels from the nodes {name}0 (tree, pos, h, n) on, and the tops."""
        text = ""
        for j in range(n):
            text += f"""
        {name}r{j} AS MATERIALIZED (SELECT tree, pos // 3 AS q, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {name}{j} WHERE n > 1 GROUP BY ALL),
        {name}{j + 1} AS MATERIALIZED (SELECT tree, q AS pos, sha256(array_to_string(hs, '')) AS h, (n + 2) // 3 AS n FROM {name}r{j}),"""
        return text + f"\n        {name}top AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, h FROM {name}{j} WHERE n = 1" for j in range(n + 1)) + "),"

    def fold_up(name: str, ways: str, n: int) -> str:
        """From the rows {ways}0 (tree, pos, x, siblings, ...) what becomes of x on the way to the top, and its siblings."""
        text = ""
        for j in range(n):
            i = f"(p.pos // {3**j}) % 3"
            before, after = f"coalesce(array_to_string(hs[1:{i}], ''), '')", f"coalesce(array_to_string(hs[{i} + 2:], ''), '')"
            text += f"""
        {ways}{j + 1} AS MATERIALIZED (
            SELECT p.* EXCLUDE (x, siblings), CASE WHEN hs IS NULL THEN x ELSE sha256({before} || x || {after}) END AS x, CASE WHEN hs IS NULL THEN siblings ELSE siblings || {before} || {after} END AS siblings
            FROM {ways}{j} p LEFT JOIN {name}r{j} r ON r.tree = p.tree AND r.q = p.pos // {3 ** (j + 1)}
        ),"""
        return text

    return f"""
        WITH d AS (
            SELECT doc_id, source, coalesce('=' || source, '-') AS tree, sha256({head} || {field_sql('text')}) AS leaf,
                   CASE WHEN {odd} = 1 THEN sha256({head} || {field_sql("replace(text, chr(10), '')")}) END AS altered
            FROM documents
        ), placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
        ), a0 AS (SELECT tree, pos, leaf AS h, n FROM placed),{climb('a', levels)}
        u0 AS MATERIALIZED (
            SELECT '' AS tree, atop.tree AS of, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n
            FROM atop JOIN (SELECT DISTINCT tree, source FROM d) s ON s.tree = atop.tree
        ),{climb('u', source_levels)}
        p0 AS (SELECT doc_id, tree, leaf, pos, coalesce(altered, leaf) AS x, '' AS siblings FROM placed),{fold_up('a', 'p', levels)}
        q0 AS (SELECT doc_id, leaf, h AS subroot, u0.tree, u0.pos, x, siblings FROM p{levels} JOIN u0 ON u0.of = p{levels}.tree),{fold_up('u', 'q', source_levels)}
        done AS (SELECT *, (SELECT h FROM utop) AS root FROM q{source_levels})
        SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, x AS folded_root, x = root AS verified FROM done
    """

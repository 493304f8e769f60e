"""Leakage-free splits: duplicate groups are dealt to train, val and test so that classes and sizes come near their shares."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import global_index, seeded_permutation
from plumbline.sources.scratch import materialize

SPLITS = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)
OVERFLOW = 2.0  # weight of what a split has above its share


def check_ratios(ratios: tuple[float, ...]) -> None:
    if len(ratios) != len(SPLITS) or any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be three positive numbers that sum to one")


def number_groups(grouped: DataFrame, group: str = "component_id") -> DataFrame:
    """(component_id, group_idx, group_id): groups by their first record, named by position."""
    firsts = grouped.select(group).distinct()
    return global_index(firsts, group, name="group_idx").withColumn("group_id", F.format_string("group-%06d", "group_idx"))


def class_counts(grouped: DataFrame, boxes: DataFrame, record: str = "record_idx", group: str = "component_id") -> DataFrame:
    """(component_id, class_id, n): boxes of each class in each group."""
    return boxes.join(grouped.select(record, group), record).groupBy(group, "class_id").agg(F.count("*").alias("n"))


def rarity(groups: DataFrame, counts: DataFrame, group: str = "component_id") -> DataFrame:
    """``groups`` with ``rarity``: the largest share of any class's boxes that a group holds, zero without boxes."""
    totals = counts.groupBy("class_id").agg(F.sum("n").alias("total"))
    each = counts.join(totals, "class_id").groupBy(group).agg(F.max(F.col("n") / F.greatest("total", F.lit(1))).alias("rarity"))
    return groups.join(each, group, "left").withColumn("rarity", F.coalesce("rarity", F.lit(0.0)))


def fold(groups: Iterator[tuple[int, int, dict]], n_images: int, totals: dict, ratios: tuple[float, ...] = RATIOS) -> Iterator[tuple[int, str, int]]:
    """(group_idx, split, position): each group in turn goes where the penalty is least.

    The penalty of a split is the squared relative miss of its image share, the mean of those of its class shares, and its relative overflow.
    Equal penalties go to the split with fewer images, then to the earlier one.
    """
    kinds = sorted(totals)
    have = [0] * len(SPLITS)
    seen = [dict.fromkeys(kinds, 0) for _ in SPLITS]
    dealt = [0] * len(SPLITS)
    for idx, size, mine in groups:
        best = None
        for s, share in enumerate(ratios):
            goal = n_images * share
            miss = ((have[s] + size - goal) / max(goal, 1)) ** 2
            spread = 0.0
            for k in kinds:
                want = totals[k] * share
                spread += ((seen[s][k] + mine.get(k, 0) - want) / max(want, 1)) ** 2
            over = max(0, have[s] + size - goal) / max(goal, 1)
            penalty = (miss + spread / max(len(kinds), 1) + OVERFLOW * over, have[s], s)
            best = penalty if best is None or penalty < best else best
        s = best[2]
        have[s] += size
        for k, n in mine.items():
            if k in seen[s]:
                seen[s][k] += n
        yield idx, SPLITS[s], dealt[s]
        dealt[s] += 1


def assign(grouped: DataFrame, counts: DataFrame, seed: int, ratios: tuple[float, ...] = RATIOS, group: str = "component_id", classes: list | None = None) -> DataFrame:
    """(group_idx, group_id, component_id, size, split, assign_pos).

    ``classes`` is the class domain, over whose length class shares are averaged; without it that of the classes that have boxes.

    Groups are shuffled by the seed, then stably sorted by rarity and size, both descending, and dealt by ``fold``. A greedy deal has no
    parallel form: it is one task over the table of groups, which has a row for a group, not for an image, and streams through it.
    """
    check_ratios(ratios)
    sizes = grouped.groupBy(group).agg(F.count("*").alias("size"))
    groups = materialize(number_groups(grouped, group).join(sizes, group), "groups")
    n = groups.count()
    spark = grouped.sparkSession
    place = spark.createDataFrame(pd.DataFrame({"g": seeded_permutation(n, seed), "shuffled_pos": range(n)}), "g long, shuffled_pos long")
    ranked = rarity(groups, counts, group).join(place, F.col("group_idx") == F.col("g"))
    held = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("class_id", "n"))).alias("counts"))
    ordered = ranked.join(held, group, "left").select("group_idx", "size", "rarity", "shuffled_pos", F.to_json("counts").alias("counts"))
    totals = {r[0]: r[1] for r in counts.groupBy("class_id").agg(F.sum("n")).collect()}  # one row a class
    if classes is not None:
        totals = {k: totals.get(k, 0) for k in classes}
    n_images = grouped.count()
    in_order = ordered.repartition(1).sortWithinPartitions(F.desc("rarity"), F.desc("size"), "shuffled_pos").select("group_idx", "size", "counts")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def rows():
            for batch in batches:
                for idx, size, mine in zip(batch.group_idx, batch["size"], batch.counts, strict=True):
                    yield idx, size, {type(next(iter(totals)))(k): v for k, v in json.loads(mine).items()} if mine else {}

        out = []
        for row in fold(rows(), n_images, totals, ratios):
            out.append(row)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["group_idx", "split", "assign_pos"])
                out = []
        yield pd.DataFrame(out, columns=["group_idx", "split", "assign_pos"])

    return groups.join(in_order.mapInPandas(deal, "group_idx long, split string, assign_pos long"), "group_idx")


def split_rank(split: str = "split"):
    """Splits in the order train, val, test."""
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col(split))


def keep_first(records: DataFrame, key: str, *order) -> DataFrame:
    """The first record of each key in the given order.

    The order is a struct that is compared field by field, so the minimum is pre-aggregated and no key's records come together.
    """
    first = records.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order)).alias("_f"))
    return records.withColumn("_o", F.struct(*order)).join(first, (F.col(key) == F.col("_k")) & (F.col("_o") == F.col("_f"))).drop("_k", "_f", "_o")


def output_names(records: DataFrame, *order, split: str = "split", stem: str = "stem") -> DataFrame:
    """``records`` with ``name``: the stem, or for the later of records with one stem in a split, the stem with the first free ``-N``.

    Image and label of a record share the name, so suffixes don't tell records apart. A record's number is its place among all records less that of
    its stem's first one, so no stem's records come together. A numbered name may itself be another's stem: only chains of stems in which
    one is reached by another's numbers are settled in order, each chain by itself in one task.
    """
    placed = global_index(records, split, stem, *order, name="_at")
    stems = materialize(placed.groupBy(split, stem).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "stems")
    chain = F.regexp_replace(stem, r"(-\d+)+$", "").alias("_chain")
    base, number = F.regexp_extract(stem, r"^(.*)-[1-9]\d{0,17}$", 1), F.regexp_extract(stem, r"-([1-9]\d{0,17})$", 1)
    numbered = stems.where(number != "").select(F.col(split).alias("_s"), base.alias("_base"), number.cast("long").alias("_j"), chain)
    met = numbered.join(stems, (F.col("_s") == F.col(split)) & (F.col("_base") == F.col(stem)) & (F.col("_j") < F.col("_n"))).select("_s", "_chain").distinct()
    met = materialize(met, "met-chains")
    keyed = placed.join(stems.withColumnsRenamed({split: "_s", stem: "_b"}), (F.col(split) == F.col("_s")) & (F.col(stem) == F.col("_b"))).drop("_s", "_b")
    k = F.col("_at") - F.col("_first")
    named = keyed.withColumn("name", F.when(k == 0, F.col(stem)).otherwise(F.concat_ws("-", F.col(stem), k.cast("string"))))
    if met.isEmpty():
        return named.select(*records.columns, "name")
    named = named.withColumn("_chain", F.regexp_replace(stem, r"(-\d+)+$", ""))
    here = (F.col(split) == F.col("_s")) & (F.col("_chain") == F.col("_c"))
    chains = met.withColumnRenamed("_chain", "_c")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        pdf = pdf.sort_values("_rank")
        for s in pdf[stem]:
            name, n = s, 0
            while name in used:
                n += 1
                name = f"{s}-{n}"
            used.add(name)
            out.append(name)
        return pdf.assign(name=out)

    many = named.join(chains, here, "left_semi").drop("name").withColumn("_rank", F.row_number().over(Window.partitionBy(split, "_chain").orderBy(*order)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in many.schema) + ", name string"
    settled = many.groupBy(split, "_chain").applyInPandas(settle, schema)
    return named.join(chains, here, "left_anti").select(*records.columns, "name").unionByName(settled.select(*records.columns, "name"))


def manifest(records: DataFrame, assigned: DataFrame, drop_copies: bool = True) -> DataFrame:
    """One row for each image that is written: where it came from, where it goes, and its group.

    Shares are balanced before exact copies are dropped; of copies the first in split, deal and record order stays.
    """
    placed = records.withColumnRenamed("split", "source_split").join(assigned.select("component_id", "group_id", "split", "assign_pos"), "component_id")
    order = (split_rank(), F.col("assign_pos"), F.col("record_idx"))
    kept = keep_first(placed, "sha256", *order) if drop_copies else placed
    named = output_names(kept, *order)
    image = F.concat_ws("/", F.col("split"), F.lit("images"), F.concat("name", "suffix"))
    return named.select(F.col("image_path").alias("source_image"), "source_split", image.alias("output_image"), "sha256", "parent_id", F.col("split").alias("output_split"), "group_id")

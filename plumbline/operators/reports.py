"""Model reports: count errors and hard examples, worst classes, differences of two models, and picture geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators.ordering import global_index, seeded_permutation

THUMB = 900  # width of a picture on the contact sheet
DELTAS = ("map50-95", "map50", "precision", "recall", "worst_class_map50_95")  # fixed values: metrics that two models are compared by


def count_errors(images: DataFrame, truths: DataFrame, predictions: DataFrame, image: str = "image") -> DataFrame:
    """(image, truth, predicted, error, min_conf, mean_conf) of every image; without predictions both confidences are 0."""
    t = truths.groupBy(image).agg(F.count("*").alias("t"))
    p = predictions.groupBy(image).agg(F.count("*").alias("p"), F.min("conf").alias("lo"), F.avg("conf").alias("mid"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    held = images.select(image).join(t, image, "left").join(p, image, "left")
    return held.select(image, n("t").alias("truth"), n("p").alias("predicted"), F.abs(n("p") - n("t")).alias("error"), F.coalesce("lo", F.lit(0.0)).alias("min_conf"), F.coalesce("mid", F.lit(0.0)).alias("mean_conf"))


def count_summary(rows: DataFrame) -> DataFrame:
    """One row of totals; rates of no images are zero."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    out = rows.agg(F.count("*").alias("images"), total("truth", "truth"), total("predicted", "predicted"), F.count_if(F.col("error") == 0).alias("exact"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("mae"))
    return out.withColumn("exact_rate", F.when(F.col("images") > 0, F.col("exact") / F.col("images")).otherwise(0.0)).withColumn("wrong", F.col("images") - F.col("exact"))


def hard_order(image: str = "image") -> list[Column]:
    """Larger errors first, then less sure ones, then by name."""
    return [F.desc("error"), F.asc("min_conf"), F.asc(image)]


def hardest(rows: DataFrame, k: int, image: str = "image") -> DataFrame:
    """The k hardest rows, by a top-k of each partition."""
    return rows.orderBy(*hard_order(image)).limit(max(k, 0))


def select_for_audit(rows: DataFrame, samples: int, seed: int, image: str = "image", order: str | None = None) -> DataFrame:
    """(pick, image): the hardest rows; where none of them has an error, the harder half of the samples and a seeded draw of the others.

    The others, in their original order (that of ``order``, or else of image), are shuffled by the seed, and the first are drawn. Only ``samples`` rows are
    collected; the shuffle is of positions, a number for each row of an audited split, on the driver.
    """
    spark = rows.sparkSession
    schema = f"pick long, {image} {rows.schema[image].dataType.simpleString()}"
    top = hardest(rows, samples, image).select(image, "error").collect()
    chosen = [r[0] for r in top]
    if top and all(r[1] == 0 for r in top):
        chosen = chosen[: (samples + 1) // 2]
        pool = global_index(rows.where(~F.col(image).isin(chosen)).select(*dict.fromkeys([image, order or image])), order or image)
        n = pool.count()
        drawn = seeded_permutation(n, seed)[: samples - len(chosen)]
        at = {r["idx"]: r[image] for r in pool.where(F.col("idx").isin(drawn)).collect()} if drawn else {}
        chosen += [at[i] for i in drawn]
    return spark.createDataFrame(list(enumerate(chosen)), schema)


def per_class(values: DataFrame, classes: DataFrame, value: str = "values") -> DataFrame:
    """(class_id, name, value): a model's array of values by class position, for the classes that there are."""
    each = values.select(*[c for c in values.columns if c != value], F.posexplode(value).alias("class_id", "value"))
    return each.join(classes, "class_id")


def worst_class(values: DataFrame, *by: str) -> DataFrame:
    """The least value over classes, none without classes."""
    return values.groupBy(*by).agg(F.min("value").alias("value"))


def find_metric(metrics: DataFrame, needle: str, *by: str) -> DataFrame:
    """(by..., value) of the first metric, in their order ``ord``, whose name has ``needle`` in it.

    Names are compared in lower case without blanks. A search for map50 passes over map50-95, but not over other names that contain it.
    """
    name = F.lower(F.replace("key", F.lit(" "), F.lit("")))
    wanted = needle.lower().replace(" ", "")
    hit = name.contains(wanted) & F.col("value").isNotNull()
    if wanted == "map50":
        hit = hit & ~name.contains("map50-95")
    return metrics.where(hit).groupBy(*by).agg(F.min_by("value", "ord").alias("value"))


def exact_metric(metrics: DataFrame, key: str, *by: str) -> DataFrame:
    """(by..., value) of the metric with this very name."""
    return metrics.where((F.col("key") == key) & F.col("value").isNotNull()).groupBy(*by).agg(F.min_by("value", "ord").alias("value"))


def model_delta(metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(metric, baseline, candidate, delta) of the metrics that both models, told by ``code``, have."""
    found = None
    for metric in DELTAS:
        find = exact_metric if metric == DELTAS[-1] else find_metric  # the worst class has a key of its own
        one = find(metrics.where(F.col("code").isin(baseline, candidate)), metric, "code").withColumn("metric", F.lit(metric))
        found = one if found is None else found.unionByName(one)
    pick = lambda code, name: F.max(F.when(F.col("code") == code, F.col("value"))).alias(name)
    both = found.groupBy("metric").agg(pick(baseline, "baseline"), pick(candidate, "candidate")).where("baseline is not null and candidate is not null")
    return both.withColumn("delta", F.col("candidate") - F.col("baseline"))


def to_pixels(boxes: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """Add left, top, right, bottom and the caption's height ``text_y`` to normalised boxes; edges may lie outside the picture."""
    w, h = F.col(width), F.col(height)
    edges = {"left": (F.col("x_center") - F.col("width") / 2) * w, "top": (F.col("y_center") - F.col("height") / 2) * h, "right": (F.col("x_center") + F.col("width") / 2) * w, "bottom": (F.col("y_center") + F.col("height") / 2) * h}
    return boxes.withColumns(edges).withColumn("text_y", F.greatest(F.lit(0.0), F.col("top") - 11))


def caption(name: str | Column, conf: str | Column) -> Column:
    """A predicted box's caption: its class and its confidence to two places, halves to even. Exact for confidences in single precision."""
    conf = F.col(conf) if isinstance(conf, str) else conf
    return F.format_string("%s %.2f", name, F.rint(conf.cast("double") * 100) / 100)


def pair_name(rank: str | Column, image: str | Column) -> Column:
    """The file name of a picture beside its predictions: its rank in two places or more, and the image's stem."""
    return F.format_string("%02d_%s.jpg", rank, paths.stem(image))


def contact_sheet(pictures: DataFrame, columns: int = 2) -> DataFrame:
    """(rank, x, y, width, height, sheet_height): pictures scaled to one width, in rows as high as their highest.

    ``pictures`` has rank (from 0), image_width and image_height. Heights are rounded half to even, and one at least.
    """
    scale = F.lit(THUMB).cast("double") / F.col("image_width")
    placed = pictures.select("rank", F.greatest(F.lit(1), F.rint(F.col("image_height") * scale).cast("int")).alias("height"), F.floor(F.col("rank") / columns).cast("long").alias("line"))
    lines = placed.groupBy("line").agg(F.max("height").alias("h"))
    # a sheet has a few dozen lines, its pictures being an audit's samples
    before = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = lines.select("line", F.coalesce(F.sum("h").over(before), F.lit(0)).cast("long").alias("y"))
    total = lines.agg(F.sum("h").cast("long").alias("sheet_height"))
    return placed.join(above, "line").join(total, how="cross").select("rank", (F.col("rank") % columns * THUMB).cast("long").alias("x"), "y", F.lit(THUMB).alias("width"), "height", "sheet_height")

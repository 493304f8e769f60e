"""Detection metrics from boxes: one-to-one matching in each image, precision and recall over all predictions, average precision.

Boxes are rows (image, class_id, left, top, right, bottom), predictions also have ``conf``. A task streams over its sorted
part and matches many images side by side in numpy; the order of all predictions by confidence is a range sort with running sums, so no class is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.groups import starts, whole_groups
from plumbline.sources.scratch import materialize

CORNERS = ("left", "top", "right", "bottom")
THRESHOLDS = tuple((50 + 5 * i) / 100 for i in range(10))  # fixed values: 0.50 to 0.95
SIZES = (("small", 0.0, 1024.0), ("medium", 1024.0, 9216.0), ("large", 9216.0, float("inf")))  # fixed values: areas below 32 and 96 pixels squared, and others
CROWDS = (("few", 1, 3), ("some", 4, 10), ("many", 11, 1 << 62))  # true objects in an image
HIT, MISS, IGNORED = 1, 0, -1
PAIRS = 1 << 20  # of boxes whose overlaps are found together
GRID = 100  # precision is read at so many steps of recall, and at none


def overlap(a, b) -> float:
    """Intersection over union of two boxes (left, top, right, bottom); zero where neither has an area."""
    inner = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return inner / union if union > 0 else 0.0


def match_boxes(predictions: list, truths: list, thresholds=THRESHOLDS, span: tuple[float, float] | None = None) -> list[list[int]]:
    """For each prediction, in their order, and each threshold: hit, miss or ignored.

    A prediction takes the free truth that it overlaps most, the first of equals, if that is at least the threshold. With ``span``, truths whose area isn't
    within it are taken only where no other one is free, and such a prediction is ignored, as is one without a truth whose own area isn't within.
    """
    inside = lambda box: span is None or span[0] <= (box[2] - box[0]) * (box[3] - box[1]) < span[1]
    wanted = [inside(t) for t in truths]
    lowest = min(thresholds)
    near = [sorted(((not wanted[j], -v, j) for j, t in enumerate(truths) if (v := overlap(p, t)) >= lowest)) for p in predictions]
    found = [[MISS if inside(p) else IGNORED] * len(thresholds) for p in predictions]
    for k, threshold in enumerate(thresholds):
        taken: set[int] = set()
        for i, options in enumerate(near):
            for other, v, j in options:
                if -v >= threshold and j not in taken:
                    taken.add(j)
                    found[i][k] = IGNORED if other else HIT
                    break
    return found


def _overlaps(guesses: np.ndarray, truths: np.ndarray, first: np.ndarray, count: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, v) of guesses and truths that overlap by ``least`` or more; guess i may have the ``count[i]`` truths from ``first[i]`` on."""
    found = []
    ends = np.cumsum(count)
    low = 0
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        n = count[low:high]
        i = np.repeat(np.arange(low, high), n)
        j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a, b = guesses[i].T, truths[j].T
        inner = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
        v = np.divide(inner, union, out=np.zeros(len(i)), where=union > 0)
        near = v >= least
        found.append((i[near], j[near], v[near]))
        low = high
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def match_groups(guesses: np.ndarray, truths: np.ndarray, place: np.ndarray, first: np.ndarray, count: np.ndarray, thresholds=THRESHOLDS, spans=((None, None),)) -> Iterator[np.ndarray]:
    """What ``match_boxes`` finds for many groups at once: for each span an array of outcomes, a row a guess and a column a threshold.

    ``place`` is a guess's place in its group, ``first`` and ``count`` tell its group's truths. Groups go side by side: their first guesses choose, then their second ones.
    """
    i, j, v = _overlaps(guesses, truths, first, count, min(thresholds))
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    inside = lambda x, low, high: np.ones(len(x), bool) if low is None else (low <= area(x)) & (area(x) < high)
    reached = v[:, None] >= np.array(thresholds)
    for low, high in spans:
        other = ~inside(truths, low, high)
        out = np.where(inside(guesses, low, high), MISS, IGNORED).astype(np.int8)[:, None].repeat(len(thresholds), 1)
        order = np.lexsort((j, -v, other[j], i, place[i]))
        taken = np.zeros((len(truths), len(thresholds)), bool)
        turns = np.flatnonzero(np.diff(place[i[order]], prepend=-1))
        for start, end in pairwise([*turns, len(order)]):
            at = order[start:end]
            free = reached[at] & ~taken[j[at]]
            heads = np.flatnonzero(np.diff(i[at], prepend=-1))
            best = np.minimum.reduceat(np.where(free, np.arange(len(at))[:, None], len(at)), heads, axis=0)
            head, k = np.nonzero(best < len(at))
            chosen = at[best[head, k]]
            taken[j[chosen], k] = True
            out[i[at[heads[head]]], k] = np.where(other[j[chosen]], IGNORED, HIT)
        yield out


def match(truths: DataFrame, predictions: DataFrame, thresholds=THRESHOLDS, spans=None) -> DataFrame:
    """(bucket, image, class_id, k, conf, hit, seen), a row for each prediction and bucket: its place in its image and class, and two numbers with a bit for
    each threshold, lowest first: whether it is a hit, and whether it counts.

    ``spans`` are (bucket, least area, area from which on it isn't in it); without them the one bucket is empty. A prediction that a
    bucket ignores at every threshold has no row there. Predictions come by falling confidence, equal ones by their corners, as truths do, so reruns
    agree. Boxes with a null anywhere aren't boxes and are passed over; an empty table of truths leaves misses, one of predictions nothing.
    """
    each = list(spans or [("", None, None)])
    held = lambda df, kind, conf: df.select("image", "class_id", F.lit(kind).alias("kind"), conf.cast("double").alias("conf"), *(F.col(c).cast("double").alias(c) for c in CORNERS)).dropna()
    both = held(truths, 0, F.lit(0.0)).unionByName(held(predictions, 1, F.col("conf")))
    key = F.struct("image", "class_id")
    together = both.repartition(key).sortWithinPartitions("image", "class_id", "kind", F.desc("conf"), *CORNERS)
    image_type, class_type = (both.schema[c].dataType.simpleString() for c in ("image", "class_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.int64(1) << np.arange(len(thresholds))
        for batch, bounds in whole_groups(batches, ["image", "class_id"]):
            guess = batch.column("kind").to_numpy() == 1
            if not guess.any():
                continue
            boxes = np.stack([batch.column(c).to_numpy() for c in CORNERS], axis=1)
            n_truths = np.add.reduceat(~guess, bounds[:-1])
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[guess]
            place = np.flatnonzero(guess) - bounds[group] - n_truths[group]
            found = match_groups(boxes[guess], boxes[~guess], place, (np.cumsum(n_truths) - n_truths)[group], n_truths[group], thresholds, [x[1:] for x in each])
            rows = batch.filter(pa.array(guess))
            for (bucket, _, _), outcome in zip(each, found, strict=True):
                hit, seen = ((x @ bits) for x in (outcome == HIT, outcome != IGNORED))
                kept = rows.filter(pa.array(seen > 0))
                columns = [pa.array([bucket] * kept.num_rows, pa.string()), kept.column("image"), kept.column("class_id"), pa.array(place[seen > 0]), kept.column("conf"), pa.array(hit[seen > 0]), pa.array(seen[seen > 0])]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "image", "class_id", "k", "conf", "hit", "seen"])

    return together.mapInArrow(run, f"bucket string, image {image_type}, class_id {class_type}, k long, conf double, hit long, seen long")


def truth_counts(truths: DataFrame, spans=None) -> DataFrame:
    """(bucket, class_id, n_truth) of classes with a true box in the bucket."""
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    whole = truths.select("class_id", "image", *(F.col(c).cast("double").alias(c) for c in CORNERS)).dropna()
    held = [F.struct(F.lit(b).alias("bucket"), (F.lit(True) if low is None else (area >= low) & (area < high)).alias("in")) for b, low, high in spans or [("", None, None)]]
    each = whole.select("class_id", F.explode(F.filter(F.array(*held), lambda x: x["in"])).alias("x"))
    return each.groupBy(F.col("x.bucket").alias("bucket"), "class_id").agg(F.count("*").alias("n_truth"))


def curves(matched: DataFrame, counts: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(bucket, class_id, n_truth, t, step, p, tp, seen), t being the threshold's position: for each step of recall that a stretch of predictions reaches the best
    precision there, and, with a null step, the point of the first threshold with the best F1 score, the earliest such.

    ``matched`` is a written table of the rows of ``match``, ``counts`` has those of ``truth_counts``. Predictions are sorted by range and cut into stretches of a class,
    which are written as bytes with their sums; sums before a stretch come from a window over stretches, so no class is one task and no point is a row.
    """
    order = ["bucket", "class_id", F.desc("conf"), F.asc("image"), F.asc("k")]
    sorted_ = matched.repartitionByRange(*order).sortWithinPartitions(*order).select("bucket", "class_id", "hit", "seen")
    class_type = matched.schema["class_id"].dataType.simpleString()
    n = len(thresholds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            bounds = np.append(starts(batch, ["bucket", "class_id"]), batch.num_rows) if batch.num_rows else [0]
            for low, high in pairwise(bounds):
                held = [batch.column(c).to_numpy()[low:high] for c in ("hit", "seen")]
                sums = [[int((x >> k & 1).sum()) for k in range(n)] for x in held]
                columns = [batch.column("bucket").slice(low, 1), batch.column("class_id").slice(low, 1), [part], [at], [held[0].tobytes()], [held[1].tobytes()], [sums[0]], [sums[1]]]
                types = [None, None, pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "class_id", "part", "at", "hits", "seens", "tp", "seen"])
                at += 1

    stretches = materialize(sorted_.mapInArrow(cut, f"bucket string, class_id {class_type}, part int, at long, hits binary, seens binary, tp array<long>, seen array<long>"), "stretches")
    earlier = Window.partitionBy("bucket", "class_id").orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.array(*(F.coalesce(F.sum(F.col(c)[k]).over(earlier), F.lit(0)) for k in range(n))).alias(c)
    before = stretches.select("bucket", "class_id", "part", "at", "tp", "seen").join(counts, ["bucket", "class_id"]).select("part", "at", "n_truth", sums("tp"), sums("seen"))
    known = stretches.drop("tp", "seen").join(before, ["part", "at"]).select("bucket", "class_id", "n_truth", "hits", "seens", "tp", "seen")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                total = batch.column("n_truth")[r].as_py()
                hits, seens = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("hits", "seens"))
                made: list[tuple] = []
                for t in range(n):
                    counted = (seens >> t & 1).astype(bool)
                    tp = np.cumsum(hits[counted] >> t & 1) + batch.column("tp")[r][t].as_py()
                    seen = np.arange(1, len(tp) + 1) + batch.column("seen")[r][t].as_py()
                    if not len(tp):
                        continue
                    step = GRID * tp // total
                    heads = np.flatnonzero(np.diff(step, prepend=-1))
                    made += [(t, s, p, None, None) for s, p in zip(step[heads].tolist(), np.maximum.reduceat(tp / seen, heads).tolist(), strict=True)]
                    if t == 0:
                        best = int(np.argmax(2 * tp / (seen + total)))
                        made.append((0, None, None, int(tp[best]), int(seen[best])))
                same = [pa.concat_arrays([batch.column(c).slice(r, 1)] * len(made)) if made else batch.column(c).slice(0, 0) for c in ("bucket", "class_id", "n_truth")]
                types = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([m[i] for m in made], x) for i, x in enumerate(types))], ["bucket", "class_id", "n_truth", "t", "step", "p", "tp", "seen"])

    return known.mapInArrow(points, f"bucket string, class_id {class_type}, n_truth long, t int, step long, p double, tp long, seen long")


def average_precision(truths: DataFrame, predictions: DataFrame, thresholds=THRESHOLDS, spans=None) -> DataFrame:
    """(bucket, class_id, n_truth, ap50, ap, precision, recall) of each class with true boxes.

    ``ap50`` is the average precision at the first threshold, ``ap`` its mean over all: the precision at 0, 0.01 to 1 of recall, each the best that is
    reached there or further on. Precision and recall are those of the first threshold at the confidence with the best F1 score, the highest such;
    without predictions all four are zero. Predictions of classes without a true box count nowhere.
    """
    counts = materialize(truth_counts(truths, spans), "truths")
    points = materialize(curves(materialize(match(truths, predictions, thresholds, spans), "matched"), counts, thresholds), "curves")
    at = ["bucket", "class_id", "t"]
    # the best precision of each step of recall, then of this or a later one: of GRID + 1 rows
    steps = points.where("step is not null").groupBy(*at, "step").agg(F.max("p").alias("p"))
    down = Window.partitionBy(*at).orderBy(F.desc("step"))
    best = F.max("p").over(down.rowsBetween(Window.unboundedPreceding, 0))
    width = F.col("step") - F.coalesce(F.lead("step").over(down), F.lit(-1))
    by_threshold = steps.select(*at, (best * width).alias("part")).groupBy(*at).agg((F.sum("part") / (GRID + 1)).alias("ap"))
    areas = by_threshold.groupBy("bucket", "class_id").agg(F.sum(F.when(F.col("t") == 0, F.col("ap"))).alias("ap50"), (F.sum("ap") / len(thresholds)).alias("ap"))
    f1 = 2 * F.col("tp") / (F.col("seen") + F.col("n_truth"))
    top = points.where("step is null").groupBy("bucket", "class_id").agg(F.max_by(F.struct((F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.col("n_truth")).alias("recall")), F.struct(f1, -F.col("seen"))).alias("x"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c.split(".")[-1])
    found = counts.join(areas, ["bucket", "class_id"], "left").join(top, ["bucket", "class_id"], "left")
    return found.select("bucket", "class_id", "n_truth", zero("ap50"), zero("ap"), zero("x.precision"), zero("x.recall"))


def mean_precision(by_class: DataFrame, *by: str) -> DataFrame:
    """The means of ``average_precision`` over classes, and the worst class's ``ap``; without a class with true boxes, and ``by``, they are null."""
    means = [F.avg(c).alias(c) for c in ("ap50", "ap", "precision", "recall")]
    return by_class.groupBy(*by).agg(F.count("*").alias("classes"), *means, F.min("ap").alias("worst_ap"))


def precision_by_size(truths: DataFrame, predictions: DataFrame, thresholds=THRESHOLDS, spans=SIZES) -> DataFrame:
    """``average_precision`` for boxes of each size. Truths of other sizes are neither hits nor misses: a prediction that matches one is ignored."""
    return average_precision(truths, predictions, thresholds, spans)


def precision_by_crowd(truths: DataFrame, predictions: DataFrame, thresholds=THRESHOLDS, crowds=CROWDS) -> DataFrame:
    """``average_precision`` over the images with so many true boxes, of all classes; predictions in images without any count nowhere."""
    n = F.col("n")
    label = F.coalesce(*(F.when((n >= low) & (n <= high), name) for name, low, high in crowds))
    crowd = materialize(truths.where(F.col("image").isNotNull()).groupBy("image").agg(F.count("*").alias("n")).select("image", label.alias("crowd")).dropna(), "crowds")
    found = None
    for name, _, _ in crowds:
        images = crowd.where(F.col("crowd") == name).select("image")
        one = average_precision(truths.join(images, "image"), predictions.join(images, "image"), thresholds).withColumn("bucket", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def side_by_side(images: DataFrame, truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """(image, truths, predictions): an image's true boxes by their corners and its predictions by falling confidence; empty arrays where it has none."""
    box = ["class_id", *CORNERS]
    t = truths.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in (*CORNERS, "class_id"))))).alias("truths"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("less"), *(F.col(c) for c in (*CORNERS, "class_id")), "conf")))
    p = predictions.groupBy("image").agg(ordered.alias("predictions"))
    as_box: dict[str, Column] = {"truths": F.transform("truths", lambda x: F.struct(*(x[c].alias(c) for c in box))), "predictions": F.transform("predictions", lambda x: F.struct(*(x[c].alias(c) for c in (*box, "conf"))))}
    return images.select("image").join(t, "image", "left").join(p, "image", "left").select("image", *(F.coalesce(v, F.array()).alias(k) for k, v in as_box.items()))


def screening_passes(baseline: DataFrame, candidate: DataFrame, minority: float = 0.1, tolerance: float = 0.05) -> DataFrame:
    """One row: whether a candidate model goes on, from both models' ``average_precision``: its mean over classes rises, its worst class doesn't fall, and no
    class with at most the share ``minority`` of all true boxes loses more than ``tolerance``. Classes that only one model has count as zero there."""
    b = baseline.select("class_id", F.col("ap").alias("old"), F.col("n_truth").alias("n"))
    c = candidate.select("class_id", F.col("ap").alias("new"), F.col("n_truth").alias("m"))
    both = b.join(c, "class_id", "full").select(F.coalesce("n", "m").alias("n"), F.coalesce("old", F.lit(0.0)).alias("old"), F.coalesce("new", F.lit(0.0)).alias("new"))
    total = both.agg(F.sum("n").alias("total"))
    held = both.join(total, how="cross")  # one row
    rare_loss = F.max(F.when(F.col("n") <= F.col("total") * minority, F.col("old") - F.col("new")))
    out = held.agg((F.avg("new") - F.avg("old")).alias("map_delta"), (F.min("new") - F.min("old")).alias("worst_delta"), F.coalesce(rare_loss, F.lit(0.0)).alias("minority_loss"))
    return out.withColumn("passes", F.coalesce(F.col("map_delta") > 0, F.lit(False)) & F.coalesce(F.col("worst_delta") >= 0, F.lit(False)) & (F.col("minority_loss") <= tolerance))

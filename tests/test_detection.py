"""Detection metrics against plain loops over lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import detection
from plumbline.operators.ordering import running_sums

TRUTH = "image long, class_id string, left double, top double, right double, bottom double"
GUESS = TRUTH + ", conf double"


def overlap(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def plain_matches(truths, guesses, threshold, low, high):
    """(conf, image, k, outcome) of all predictions of a class, image by image."""
    out = []
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    for image in sorted({g[0] for g in guesses}):
        own = sorted((g for g in guesses if g[0] == image), key=lambda g: (-g[6], g[2:6]))
        free = sorted((t for t in truths if t[0] == image), key=lambda t: t[2:6])
        for k, g in enumerate(own):
            for wanted in (True, False):
                fits = [(overlap(g[2:6], t[2:6]), -i) for i, t in enumerate(free) if t and (low <= size(t[2:6]) < high) == wanted and overlap(g[2:6], t[2:6]) >= threshold]
                if fits:
                    free[-max(fits)[1]] = None
                    out.append((g[6], image, k, 1 if wanted else -1))
                    break
            else:
                out.append((g[6], image, k, 0 if low <= size(g[2:6]) < high else -1))
    return out


def plain_ap(truths, guesses, low=0.0, high=float("inf")):
    """{class: (n_truth, ap50, ap, precision, recall)}"""
    found = {}
    inside = lambda t: low <= (t[4] - t[2]) * (t[5] - t[3]) < high
    for c in {t[1] for t in truths if inside(t)}:
        own = [t for t in truths if t[1] == c]
        n = sum(map(inside, own))
        aps, top = [], (0.0, 0.0)
        for i in range(10):
            tp = seen = 0
            points = []
            for _, _, _, hit in sorted(plain_matches(own, [g for g in guesses if g[1] == c], (50 + 5 * i) / 100, low, high), key=lambda m: (-m[0], m[1], m[2])):
                if hit >= 0:
                    tp, seen = tp + hit, seen + 1
                    points.append((tp, seen))
            aps.append(sum(max((a / b for a, b in points if 100 * a >= r * n), default=0.0) for r in range(101)) / 101)
            if i == 0 and points:
                a, b = max(points, key=lambda p: (2 * p[0] / (p[1] + n), -p[1]))
                top = (a / b, a / n)
        found[c] = (n, aps[0], sum(aps) / 10, *top)
    return found


def scene(images=40, seed=2):
    rnd = random.Random(seed)
    truths, guesses = [], []
    for image in range(images):
        for _ in range(rnd.choice([0, 1, 2, 5, 12])):
            x, y, side = rnd.randint(0, 20) * 10, rnd.randint(0, 20) * 10, rnd.choice([10, 30, 40, 90, 120])
            c = rnd.choice("aab")
            truths.append((image, c, float(x), float(y), float(x + side), float(y + side)))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                d = side * rnd.choice([0, 0.02, 0.1, 0.3])
                guesses.append((image, rnd.choice([c, c, c, "b", "z"]), float(x + d), float(y), float(x + side + d), float(y + side), rnd.choice([0.3, 0.5, 0.9, rnd.random()])))
    truths += truths[:5]  # repeated rows are boxes of their own
    guesses += guesses[:5]
    truths.append((1, "none found", 0.0, 0.0, 50.0, 50.0))
    return truths, guesses


def frames(spark, truths, guesses):
    return spark.createDataFrame(truths, TRUTH), spark.createDataFrame(guesses, GUESS)


def as_found(rows):
    return {r.class_id: (r.n_truth, r.ap50, r.ap, r.precision, r.recall) for r in rows}


def test_average_precision(spark):
    truths, guesses = scene()
    got = as_found(detection.average_precision(*frames(spark, truths + [(None, "a", 0.0, 0.0, 1.0, 1.0), (1, "a", None, 0.0, 1.0, 1.0)], guesses + [(1, "a", 0.0, 0.0, 1.0, 1.0, None)])).collect())
    want = plain_ap(truths, guesses)
    assert got.keys() == want.keys() == {"a", "b", "none found"}
    for c in want:
        assert got[c] == pytest.approx(want[c])


def test_sizes_ignore_other_truths(spark):
    truths, guesses = scene(60, 9)
    rows = detection.precision_by_size(*frames(spark, truths, guesses)).collect()
    for name, low, high in detection.SIZES:
        got, want = as_found(r for r in rows if r.bucket == name), plain_ap(truths, guesses, low, high)
        assert got.keys() == want.keys()
        for c in want:
            assert got[c] == pytest.approx(want[c])


def test_a_match_outside_the_size_is_no_miss():
    big, small = (0.0, 0.0, 100.0, 100.0), (0.0, 0.0, 20.0, 20.0)
    assert detection.match_boxes([big, small], [big, small], (0.5,), (0.0, 1024.0)) == [[-1], [1]]
    assert detection.match_boxes([small], [big], (0.5,), (0.0, 1024.0)) == [[0]]
    assert detection.match_boxes([big], [], (0.5,), (0.0, 1024.0)) == [[-1]]


@pytest.mark.parametrize("span", [None, (0.0, 1024.0), (1024.0, 9216.0)])
def test_groups_side_by_side_are_matched_as_one_by_one(monkeypatch, span):
    monkeypatch.setattr(detection, "PAIRS", 7)
    truths, guesses = scene(30, 6)
    keys = sorted({g[:2] for g in guesses})
    t = {k: sorted(x[2:6] for x in truths if x[:2] == k) for k in keys}
    g = {k: [x[2:6] for x in sorted((x for x in guesses if x[:2] == k), key=lambda x: (-x[6], x[2:6]))] for k in keys}
    first = np.cumsum([0, *(len(t[k]) for k in keys)])
    each = [(x, i, first[n], len(t[k])) for n, k in enumerate(keys) for i, x in enumerate(g[k])]
    boxes, place, start, count = (np.array(c) for c in zip(*each, strict=True))
    (got,) = detection.match_groups(boxes, np.array([x for k in keys for x in t[k]]).reshape(-1, 4), place, start, count, spans=[span or (None, None)])
    assert got.tolist() == [hits for k in keys for hits in detection.match_boxes(g[k], t[k], span=span)]


def test_crowds_take_whole_images(spark):
    truths, guesses = scene(50, 4)
    rows = detection.precision_by_crowd(*frames(spark, truths, guesses)).collect()
    sizes = {i: sum(t[0] == i for t in truths) for i in {t[0] for t in truths}}
    for name, low, high in detection.CROWDS:
        held = {i for i, n in sizes.items() if low <= n <= high}
        want = plain_ap([t for t in truths if t[0] in held], [g for g in guesses if g[0] in held])
        got = as_found(r for r in rows if r.bucket == name)
        assert got.keys() == want.keys()
        for c in want:
            assert got[c] == pytest.approx(want[c])


def test_nothing_to_measure(spark):
    truths, guesses = scene(5)
    none, nothing = frames(spark, [], [])
    assert detection.average_precision(none, nothing).collect() == []
    assert detection.average_precision(none, frames(spark, truths, guesses)[1]).collect() == []
    only = as_found(detection.average_precision(frames(spark, truths, guesses)[0], nothing).collect())
    assert only and all(v[1:] == (0.0, 0.0, 0.0, 0.0) for v in only.values())
    assert detection.mean_precision(detection.average_precision(none, nothing)).first().classes == 0


def test_screening(spark):
    schema = "class_id string, n_truth long, ap double"
    base = spark.createDataFrame([("a", 90, 0.5), ("b", 5, 0.4)], schema)
    rows = {"better": [("a", 90, 0.6), ("b", 5, 0.4)], "worst falls": [("a", 90, 0.9), ("b", 5, 0.39)], "rare falls": [("a", 90, 0.45), ("b", 5, 0.8)], "same": [("a", 90, 0.5), ("b", 5, 0.4)]}
    got = {k: detection.screening_passes(base, spark.createDataFrame(v, schema)).first().passes for k, v in rows.items()}
    assert got == {"better": True, "worst falls": False, "rare falls": True, "same": False}
    damaged = detection.screening_passes(spark.createDataFrame([("a", 90, 0.2), ("b", 5, 0.5)], schema), spark.createDataFrame([("a", 90, 0.9), ("b", 5, 0.4)], schema)).first()
    assert not damaged.passes and damaged.minority_loss == pytest.approx(0.1) and damaged.worst_delta > 0


def test_running_sums(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["x", "x", "x", "y", None]), i, rnd.choice([None, 1, 2])) for i in range(500)]
    got = running_sums(spark.createDataFrame(data, "g string, i long, v long").repartition(7), ["g"], [F.desc("i")], {"total": F.col("v"), "n": F.lit(1).cast("long")}).collect()
    sums = {}
    want = {}
    for g, i, v in sorted(data, key=lambda r: -r[1]):
        t, n = sums.get(g, (0, 0))
        sums[g] = want[i] = (t + (v or 0), n + 1)
    assert {r.i: (r.total, r.n) for r in got} == want


def test_side_by_side(spark):
    truths, guesses = frames(spark, [(1, "a", 0.0, 0.0, 1.0, 1.0)], [(1, "b", 0.0, 0.0, 1.0, 1.0, 0.2), (1, "a", 0.0, 0.0, 1.0, 1.0, 0.9)])
    got = {r.image: r for r in detection.side_by_side(spark.createDataFrame([(1,), (2,)], "image long"), truths, guesses).collect()}
    assert [p.conf for p in got[1].predictions] == [0.9, 0.2] and len(got[1].truths) == 1
    assert got[2].truths == [] and got[2].predictions == []

"""Operators of the audit engine on small cases worked out by hand."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import hashes, paths, raster
from plumbline.operators import adapter, audit, components, labels, reports, skew, split
from plumbline.operators.components import connected_components
from plumbline.operators.ordering import global_index, seeded_permutation


def parsed(spark, lines, classes=(0, 1)):
    given_ = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string")
    known = spark.createDataFrame([(c,) for c in classes], "class_id int")
    return {r.line_no: r for r in labels.parse_lines(given_, known).collect()}


def test_label_lines(spark):
    cases = [
        ("0 0.5 0.5 0.2 0.2", None),
        ("0 0.9 0.5 0.5 0.2", None),  # it overhangs
        ("0 0.1 0.1 0.3 0.1 0.3 0.5", None),
        ("0", "polygon"),
        ("0 0.1 0.2", "polygon"),
        ("0 .1 .2 .3 .4 .5", "polygon"),
        ("0 .1 .2 .3 .4 .5 .6 .7", "polygon"),
        ("1.0 0.5 0.5 0.2 0.2", "not_numeric"),
        ("a 0.5 0.5 0.2 0.2", "not_numeric"),
        ("0 0.5 1f 0.2 0.2", "not_numeric"),
        ("9 0.5 0.5 0.2 0.2", "class"),
        ("0 nan 0.5 0.2 0.2", "non_finite"),
        ("0 0.5 inf 0.2 0.2", "non_finite"),
        ("0 1.2 0.5 0.2 0.2", "range"),
        ("0 0.5 0.5 0 0.2", "empty_box"),
        ("0_1 0.5 0.5 0.2 0.2", None),
        ("\t1\x1f0.5  0.5 2e-1 +.2 ", None),
    ]
    found = parsed(spark, [c[0] for c in cases])
    assert [found[i].error for i in range(len(cases))] == [c[1] for c in cases]
    outline = found[2]
    assert np.allclose((outline.x_center, outline.y_center, outline.width, outline.height), (0.2, 0.3, 0.2, 0.4))
    assert found[15].class_id == 1


def test_first_bad_line_quarantines_the_image(spark):
    texts = spark.createDataFrame([("a", "0 .5 .5 .1 .1\n\n9 .5 .5 .1 .1\nx"), ("b", "0 .5 .5 .1 .1"), ("c", " \n")], "image string, text string")
    known = spark.createDataFrame([(0,)], "class_id int")
    lines = labels.parse_lines(labels.split_lines(texts), known)
    assert [tuple(r) for r in labels.quarantine(lines, "image").collect()] == [("a", "class", 3)]
    assert [r.image for r in labels.valid_boxes(lines, "image").collect()] == ["b"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_are_those_of_a_union_find(spark, edges):
    home = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            home[a] = home[b] = min(home[a], home[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in home} == home
    assert set(found) <= linked


def test_components_over_many_steps(spark, monkeypatch):
    """Long paths, a hub, a comb and trees, none of which one task may finish; few nodes a task, so that sets meet late."""
    monkeypatch.setattr(components, "FINISH", 0)
    monkeypatch.setattr(components, "NODES", 20)
    monkeypatch.setattr(skew, "SHARE", 4)
    rnd = random.Random(6)
    names = list(range(600))
    rnd.shuffle(names)
    pairs = [(i, i + 1) for i in range(99)] + [(100, i) for i in range(101, 250)] + [(i, i + 100) for i in range(260, 300)] + [(i, i // 2) for i in range(401, 500) if i // 2 > 400]
    pairs += [(300 + rnd.randrange(60), 300 + rnd.randrange(60)) for _ in range(80)] + [(500, 500), (501, 502), (502, 501), (501, 502)]
    edges = [(names[a], names[b]) if rnd.random() < 0.5 else (names[b], names[a]) for a, b in pairs]
    home = {n: n for e in edges for n in e}
    while any(home[a] != home[b] for a, b in edges):
        for a, b in edges:
            home[a] = home[b] = min(home[a], home[b])
    text = lambda n: f"{n:05d}"
    rows = [*((text(a), text(b)) for a, b in edges), (None, text(1)), (text(2), None)]
    rnd.shuffle(rows)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a string, b string").repartition(5)).collect()}
    assert found == {text(n): text(r) for n, r in home.items() if n != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("threshold", [0, 1, 4, 6, 7, 9, 64])
@pytest.mark.parametrize("keyed_by", [1, 2, 3, 8])
@pytest.mark.parametrize("colour", ["mean_rgb", None])
def test_near_pairs_by_combinations_of_bytes(spark, monkeypatch, threshold, keyed_by, colour):
    rnd = random.Random(threshold)
    base = [rnd.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(120):
        h = rnd.choice(base)
        for _ in range(rnd.choice([0, 1, 3, 5, 12])):
            h ^= 1 << rnd.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h, [rnd.choice([0.0, 11.9, 12.0, 24.0, 255.0]), 5.0, rnd.choice([5.0, 17.0, 17.1])]))
    near = lambda x, y: max(abs(p - q) for p, q in zip(x[2], y[2], strict=True)) <= 12 if colour else True
    shares = lambda x, y: any((x >> 8 * k & 255) == (y >> 8 * k & 255) for k in range(8))
    unsigned = lambda h: h & (1 << 64) - 1
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y) and bin(unsigned(x[1]) ^ unsigned(y[1])).count("1") <= threshold and shares(unsigned(x[1]), unsigned(y[1]))}
    monkeypatch.setattr(audit, "equal_bytes", lambda n, t: min(max(8 - t, 1), keyed_by))
    got = [tuple(r) for r in audit.near_pairs(spark.createDataFrame(rows, "record_idx long, dhash long, mean_rgb array<double>"), threshold, colour=colour).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("colour", ["mean_rgb", None])
def test_frequent_bytes_are_compared_block_by_block(spark, monkeypatch, colour):
    """Most hashes share six bytes, so each key of theirs is cut into many blocks, some of them empty."""
    monkeypatch.setattr(audit, "BLOCK", 5)
    rnd = random.Random(8)
    rows = [(i, rnd.getrandbits(6) << 8 | rnd.getrandbits(3) if rnd.random() < 0.8 else rnd.getrandbits(62), [float(rnd.choice([0, 12, 13, 40])), 0.0, 0.0]) for i in range(150)]
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and bin(x[1] ^ y[1]).count("1") <= 3 and (not colour or abs(x[2][0] - y[2][0]) <= 12)}
    pairs = audit.near_pairs(spark.createDataFrame(rows, "record_idx long, dhash long, mean_rgb array<double>"), 3, colour=colour)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_long_groups_are_compared_in_rows_of_blocks():
    h = np.array([random.Random(i).getrandbits(6) for i in range(400)], np.uint64)
    side = np.array([0] * 200 + [1] * 90 + [2] * 110, np.int8)
    at = np.array([0, 200, 400])
    near = lambda i, j: bin(int(h[i]) ^ int(h[j])).count("1") <= 1
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if near(i, j)} | {(i, j) for i in range(200, 290) for j in range(290, 400) if near(i, j)}
    for most in (8, 1000):
        i, j = audit.close_in_groups(h, at, side, 1, most)
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_near_pairs_send_no_side_of_a_join_to_all_tasks(spark):
    rows = [(i, i * 7919, [float(i % 40)] * 3) for i in range(50)]
    records = spark.createDataFrame(rows, "record_idx long, dhash long, mean_rgb array<double>")
    for colour in ("mean_rgb", None):
        for found in (audit.near_pairs(records, 4, colour=colour), audit.near_pair_count(records, 4, colour=colour)):
            assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_keys_grow_with_the_hashes():
    assert [audit.equal_bytes(n, 4) for n in (0, 200, 257, 1 << 17, 1 << 30)] == [1, 1, 2, 3, 4]
    assert [audit.equal_bytes(1 << 40, t) for t in (0, 3, 7, 8, 16)] == [5, 5, 1, 1, 1]


def record_rows(spark, rows):
    return spark.createDataFrame(rows, "record_idx long, split string, image_path string, sha256 string, parent_id string, dhash long, mean_rgb array<double>, signature string")


def test_copy_across_splits_is_unsafe(spark):
    rows = [(i, "train" if i < 3 else "test", f"{i}.png", f"h{i % 4}", f"p{i}", 0, [float(i * 50)] * 3, "[]") for i in range(5)]
    records = record_rows(spark, rows)
    boxes = spark.createDataFrame([(i, i % 2) for i in range(5)], "record_idx long, class_id int")
    classes = spark.createDataFrame([(0, "normal"), (1, "defect"), (2, "none")], "class_id int, name string")
    errors = spark.createDataFrame([], "image_path string")
    report = audit.audit(records, boxes, classes, errors).first()
    assert (report.exact_pairs, report.parent_pairs, report.duplicate_components, report.n_cross_split, report.n_conflicts, report.safe) == (1, 0, 1, 1, 0, False)
    assert report.boxes_by_class == {0: 3, 1: 2, 2: 0} and report.images_by_split == {"train": 3, "test": 2} and report.near_pairs == 0


def test_nothing_is_safe(spark):
    none = record_rows(spark, [])
    boxes = spark.createDataFrame([], "record_idx long, class_id int")
    classes = spark.createDataFrame([(0, "x")], "class_id int, name string")
    assert audit.audit(none, boxes, classes, spark.createDataFrame([], "e string"), -1).first().safe


def test_near_pairs_at_the_limits(spark):
    rows = [(0, 0, [0.0, 0.0, 0.0]), (1, 0b1111, [12.0, 0.0, 0.0]), (2, 0b11111 << 8, [0.0] * 3), (3, 0b1111 << 56, [12.1, 0.0, 0.0]), (4, 0, [0.0, 0.0, 0.0])]
    records = spark.createDataFrame([(i, h if h < 1 << 63 else h - (1 << 64), m) for i, h, m in rows], "record_idx long, dhash long, mean_rgb array<double>")
    assert sorted(tuple(r) for r in audit.near_pairs(records, 4).collect()) == [(0, 1), (0, 4), (1, 4)]


def test_conflicts_and_chains(spark):
    rows = [(0, "train", "a", "h", "x", 0, None, "1"), (1, "train", "b", "h", "y", 0, None, "2"), (2, "test", "c", "g", "y", 0, None, "2")]
    records = record_rows(spark, rows)
    assert [tuple(r) for r in audit.conflicts(records, "sha256", "signature").collect()] == [("h", 2, 2)]
    assert {r.component_id for r in audit.components(records, ["sha256", "parent_id"]).collect()} == {0}


@pytest.mark.parametrize(("sizes", "splits"), [((5, 3, 2), ["train", "train", "val"]), ((7, 1, 1, 1), ["train", "val", "test", "train"])])
def test_greedy_deal(sizes, splits):
    total = sum(sizes)
    dealt = list(split.fold(((i, n, {0: n}) for i, n in enumerate(sizes)), total, {0: total}))
    assert [d[1] for d in dealt] == splits


def test_ratios():
    for wrong in ((0.7, 0.3), (0.5, 0.5, 0.5), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError, match="ratios"):
            split.check_ratios(wrong)


def test_names_that_collide(spark):
    rows = [(0, "train", "a", ".jpg"), (1, "train", "a", ".png"), (2, "train", "a-1", ".png"), (3, "val", "a", ".png"), (4, "train", "b", ".png")]
    named = split.output_names(spark.createDataFrame(rows, "i int, split string, stem string, suffix string"), F.col("i"))
    assert {r.i: r["name"] for r in named.collect()} == {0: "a", 1: "a-1", 2: "a-1-1", 3: "a", 4: "b"}


def test_global_index_and_seeds(spark):
    held = global_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), "v")
    assert all(r.v == r.idx for r in held.collect())
    want = list(range(9))
    random.Random(3).shuffle(want)
    assert seeded_permutation(9, 3) == want


def test_paths(spark):
    names = spark.createDataFrame([("x/foo_jpg.rf.ab.rf.c.jpg",), ("foo.jpg",), (".rf.x.jpg",), ("d.e/A.JPG",), ("d/_a.webp",), ("d/a.txt",)], "p string")
    found = names.select(paths.parent_id("p").alias("parent"), paths.is_image("p").alias("image"), paths.label_path("p").alias("label")).collect()
    assert [r.parent for r in found] == ["foo_jpg", "foo", "", "A", "_a", "a"]
    assert [r.image for r in found] == [True, True, True, True, True, False]
    assert found[3].label == "d.e/A.txt"


def test_metric_lookup_keeps_to_its_order(spark):
    rows = [("m", 0, "metrics/mAP50-95(B)", 0.41), ("m", 1, "metrics/mAP50(B)", 0.73), ("n", 0, "other", 0.9), ("n", 1, "worst_class_map50_95", 0.2)]
    metrics = spark.createDataFrame(rows, "code string, ord int, key string, value double")
    assert {r.code: r.value for r in reports.find_metric(metrics, "mAP50", "code").collect()} == {"m": 0.73, "n": 0.2}
    assert {r.code: r.value for r in reports.find_metric(metrics, "mAP50-95", "code").collect()} == {"m": 0.41}


def test_audit_sample(spark):
    rows = [("easy", 0, 0.2), ("hard", 3, 0.9), ("medium", 1, 0.1)]
    held = spark.createDataFrame(rows, "image string, error long, min_conf double")
    assert [r.image for r in reports.select_for_audit(held, 2, 42).orderBy("pick").collect()] == ["hard", "medium"]
    assert reports.select_for_audit(held.withColumn("error", F.lit(0).cast("long")), 3, 42).count() == 3
    assert reports.select_for_audit(held, 0, 42).isEmpty()


def test_adapter_is_the_identity_without_output(spark):
    left, right = np.arange(12).reshape(3, 4) / 10, np.ones((3, 4))
    x = spark.createDataFrame([([0.5, -1.0, 2.0, 0.0],)], "x array<float>")
    assert x.select(adapter.bilinear_adapter("x", left, right, np.zeros((4, 3))).alias("y")).first().y == [0.5, -1.0, 2.0, 0.0]
    with pytest.raises(ValueError, match="weights"):
        adapter.bilinear_adapter("x", left, np.ones((2, 4)), np.zeros((4, 3)))


def test_adapter_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    left, right, out, x = rng.normal(size=(3, 5)), rng.normal(size=(3, 5)), rng.normal(size=(5, 3)), rng.normal(size=5)
    z = (left @ x) * (right @ x)
    z = np.sign(z) * np.sqrt(np.abs(z) + 1e-6)
    want = x + 0.5 * out @ (z / max(np.linalg.norm(z), 1e-6))
    held = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    assert np.allclose(held.select(adapter.bilinear_adapter("x", left, right, out, 0.5).alias("y")).first().y, want)


def test_hash_functions(spark):
    row = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0], -1)], "v array<double>, h long").select(hashes.difference_bits("v").alias("d"), hashes.bands("h").alias("b")).first()
    assert row.d == 0b101 and [int(b) for b in row.b] == [255] * 8


def test_raster_features():
    flat = np.full((24, 24, 3), 130, np.uint8)
    assert raster.difference_hash(flat) == 0 and raster.mean_rgb(flat) == [130.0] * 3
    ramp = np.repeat(np.arange(0, 240, 10, dtype=np.uint8)[None, :, None], 24, axis=0).repeat(3, axis=2)
    assert raster.difference_hash(ramp) == -1  # all 64 bits
    assert np.allclose(raster.weights(24, 9, raster.lanczos, 3).sum(axis=1) / (1 << raster.BITS), 1)


def test_plain_and_other_lines_follow_the_same_rules(spark):
    lines = ["0 0.5 0.5 0.2 0.2", " 0\t.5  0.5 0.2\t0.2 ", "0 5e-1 0.5 0.2 0.2", "0 0.5 0.5 0.2 0.2\x0b", "0 -0.1 0.5 0.2 0.2", "0 0.5 0.5 0 0.2", "0 0.5 0.5 -0.2 0.2", "9 0.5 0.5 0.2 0.2", "0 0.5 0.5 0.2 " + "9" * 400, "0 . 0.5 0.2 0.2"]
    got = parsed(spark, lines)
    assert [got[i].error for i in range(len(lines))] == [None] * 4 + ["range", "empty_box", "range", "class", "non_finite", "not_numeric"]
    assert {(got[i].class_id, got[i].x_center, got[i].y_center, got[i].width, got[i].height) for i in range(4)} == {(0, 0.5, 0.5, 0.2, 0.2)}
    assert labels.quarantine(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "image string, line_no int, error string"), "image", count=True).collect() == [("a", "y", 1, 2)]


def test_polygons_are_read_without_a_function_for_each_number(spark):
    """Signed names of numbers, a polygon of very many points, NaNs in each place; cast, checked and compared as whole arrays."""
    points = " ".join(f"0.{1 + i % 8}" for i in range(60_000))
    lines = ["0 +nan 0.5 0.2 0.2", "0 0.5 -NaN 0.2 0.2", "0 0.5 0.5 +Infinity 0.2", f"0 {points}", f"0 {points} x", "0  .1 1_0e-2\u2003.3 nan .3 0.4\r", "0 nan .1 .3 .1 .3 .4", "0 .1 .1 inf .1 .3 .4", "0 .1 .1 .3 nan nan .4", "+1_0 .1 .1 .3 .1 .3 .4", "0 .1 .1 .3 .1 .3 .4_", "1", "", None]
    got = parsed(spark, lines)
    assert [got[i].error for i in range(len(lines))] == ["non_finite"] * 3 + [None, "not_numeric", None, "non_finite", "non_finite", None, "class", "not_numeric", "polygon", "not_numeric", "class"]
    boxes = [(got[i].x_center, got[i].y_center, got[i].width, got[i].height) for i in (3, 5, 8)]
    assert np.allclose(boxes, [(0.4, 0.5, 0.6, 0.6), (0.2, 0.25, 0.2, 0.3), (0.2, 0.25, 0.2, 0.3)])
    plan = labels.parse_lines(spark.createDataFrame([("0",)], "line string"), spark.createDataFrame([(0,)], "class_id int"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") == 2  # a polygon's x and y


def test_join_one_spreads_heavy_keys_and_keeps_the_others(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 4)
    data = [(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i % 7}") for i in range(60)]
    many = spark.createDataFrame(data, "i long, k string")
    one = many.where("k is not null").groupBy("k").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted((r.i, r.k or "", r["first"]) for r in skew.join_one(many, one, "k", "n", how).collect())
        firsts = {k: min(i for i, x in data if x == k) for _, k in data if k}
        assert got == sorted((i, k or "", firsts.get(k)) for i, k in data if k or how == "left")
    assert skew.join_one(many.limit(0), one.limit(0), "k", "n").count() == 0


def test_near_counts_and_edges_are_those_of_the_pairs(spark):
    """Heaps of equal hashes, near ones, a lone one, one of another colour and one without a hash."""
    rows = [(i, 5, [1.0, 1.0, 1.0]) for i in range(4)] + [(9, 7, [1.0, 1.0, 1.0]), (11, 7, [1.0, 1.0, 1.0]), (12, 7, [99.0, 1.0, 1.0]), (13, -1, [1.0, 1.0, 1.0]), (14, None, None), (15, None, None)]
    df = spark.createDataFrame(rows, "record_idx long, dhash long, mean_rgb array<double>")
    pairs = {tuple(r) for r in audit.near_pairs(df, 4).collect()}
    assert len(pairs) == 6 + 1 + 4 * 2
    assert audit.near_pair_count(df, 4).first()[0] == len(pairs)
    assert {tuple(r) for r in connected_components(audit.near_edges(df, 4)).collect()} == {tuple(r) for r in connected_components(audit.near_pairs(df, 4)).collect()}
    assert audit.near_pair_count(df.limit(0), 4).first()[0] == 0


def test_adapter_of_maps(spark):
    """The default rank at 256 channels, maps of two sizes in one batch, null and empty ones; planning it takes no time."""
    rng = np.random.default_rng(8)
    left, right, out = rng.normal(size=(adapter.RANK, 256)), rng.normal(size=(adapter.RANK, 256)), rng.normal(size=(256, adapter.RANK))
    one, two = rng.normal(size=(256, 3, 4)), rng.normal(size=(256, 2, 1))
    rows = [(1, one.ravel().tolist()), (2, None), (3, []), (4, two.ravel().tolist()), (5, [None] * 256)]
    maps = spark.createDataFrame(rows, "i int, features array<double>").coalesce(1)
    began = time.perf_counter()
    adapted = adapter.adapt_maps(maps, left, right, out, scale=0.3)
    assert time.perf_counter() - began < 2
    got = {r.i: r.adapted for r in adapted.collect()}
    for i, m in ((1, one), (4, two)):
        want = adapter.forward(m.reshape(256, -1), left, right, out, 0.3, adapter.EPS)
        pixel = m[:, 0, 0]
        z = (left @ pixel) * (right @ pixel)
        z = np.sign(z) * np.sqrt(np.abs(z) + adapter.EPS)
        assert np.allclose(want[:, 0], pixel + 0.3 * out @ (z / np.linalg.norm(z))) and np.allclose(got[i], want.ravel())
    assert got[2] is None and got[5] is None and got[3] == []
    head = rng.normal(size=(7, 256)), rng.normal(size=7)
    logits = adapter.adapt_maps(maps.where("i = 1"), left, right, np.zeros_like(out), branch=head).first().adapted
    assert np.allclose(np.reshape(logits, (7, 3, 4)), np.einsum("kc,chw->khw", head[0], one) + head[1][:, None, None])
    with pytest.raises(ValueError, match="branch"):
        adapter.adapt_maps(maps, left, right, out, branch=(head[0], head[1][:2]))


def test_rasters_in_a_column(spark):
    """A ramp, a flat picture, one with a short last row and none; the grid's hash by built-in functions is a second way to the same bits."""
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 256, (50, 40, 3), dtype=np.uint8)
    ramp = np.repeat(np.arange(40, dtype=np.uint8)[None, :, None] * 6, 30, axis=0).repeat(3, axis=2)
    rows = [(1, ramp.tobytes()), (2, bytes([7]) * 40 * 3 * 9), (3, noise.tobytes()), (4, noise.tobytes()[:-31]), (5, b""), (6, None)]
    held = raster.sample_features(spark.createDataFrame(rows, "i int, data binary"), "data", 40)
    got = {r.i: r for r in held.collect()}
    assert got[1].dhash == -1 and got[2].dhash == 0 and got[2].mean_rgb == [7.0, 7.0, 7.0]
    assert got[5].dhash is None and got[6].mean_rgb is None
    cut = noise.copy().reshape(-1)
    cut[-31:] = 0
    for i, picture in ((3, noise), (4, cut.reshape(noise.shape))):
        small = raster.resample(raster.grey(picture), raster.HASH_SIZE, raster.lanczos, 3)
        bits = spark.createDataFrame([(small.ravel().tolist(),)], "g array<long>").select(hashes.grid_difference_hash("g").alias("h")).first().h
        assert got[i].dhash == bits == raster.difference_hash(picture)
        assert np.allclose(got[i].mean_rgb, [raster.resample(picture[..., c], raster.MEAN_SIZE, raster.triangle, 1).mean() for c in range(3)])
    # a flat picture keeps its brightness at any size, and fixed weights differ from exact ones by less than a step
    exact = rng.integers(0, 256, (33, 21)).astype(float)
    away = raster.weights(21, 9, raster.lanczos, 3) / (1 << raster.BITS)
    assert np.abs(np.clip(exact @ away.T, 0, 255) - raster.resample(exact, (9, 33), raster.lanczos, 3)).max() <= 1.01

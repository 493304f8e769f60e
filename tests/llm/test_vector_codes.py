"""Vector codes against Lloyd's rounds written out over lists."""

import hashlib
import math
import random

import numpy as np
import pytest

from plumbline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, i int"


def nearest(p, book):
    return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), e) for e, c in enumerate(book))


def plain(data, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(r[0], r[2], [math.floor(float(np.float32(x)) * scale) for x in r[1]]) for r in data if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and len(r[1]) % parts == 0]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(order[0][2])]
    first = {}
    for r in order:
        if len(r[2]) == len(order[0][2]):
            first.setdefault(r[0], r[2])
    cut = lambda v: [v[i * len(v) // parts : (i + 1) * len(v) // parts] for i in range(parts)]
    seeds = [cut(v) for v in list(first.values())[:entries]]
    books = [[s[p] for s in seeds] for p in range(parts)]
    cuts = [cut(r[2]) for r in kept]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cuts:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, g in groups.items():
                books[p][e] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cuts]
    errors, total = [sum(d for d, _ in f) for f in found], {}
    for r, e in zip(kept, errors, strict=True):
        total[r[1]] = total.get(r[1], 0) + e
    return [(r[0], "".join(f"{e:02x}" for _, e in f), err, total[r[1]], sha) for r, f, err in zip(kept, found, errors, strict=True)]


def vectors(n=300, width=16, seed=4):
    rnd = random.Random(seed)
    data = [(i, [rnd.choice([rnd.gauss(0, 0.1), round(rnd.gauss(0, 0.5), 1)]) for _ in range(width)], rnd.choice([1, 2, None]), "c", 1, 2) for i in range(50, 50 + n)]
    same = [0.25] * width
    data += [(1000 + i, same, 7, "c", 1, 2) for i in range(150)]  # one vector that a third of all rows have
    data += [(60, same, 3, None, None, None)] * 3 + [(51, [1.0] * width, 1, None, None, None), (None, same, None, None, None, None)]
    data += [(1, None, 1, "c", 1, 2), (2, [None] * width, 1, "c", 1, 2), (3, [float("nan")] * width, 1, "c", 1, 2), (4, [float("inf")] + [0.0] * (width - 1), 1, "c", 1, 2)]
    return [*data, (5, [], 1, "c", 1, 2), (6, [0.5] * 7, 1, "c", 1, 2), (2000, [0.5] * 8, 1, "c", 1, 2)]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("chunk", [4096, 50])
def test_against_plain_rounds(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    data = vectors()
    got = vector_codes.compress(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(data), key=key)


def test_few_and_none(spark):
    data = vectors()[:5]
    got = vector_codes.compress(spark.createDataFrame(data, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(data), key=key)
    empty = vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 0, 0)], SCHEMA))
    assert empty.collect() == [] and empty.columns == got.columns


@pytest.mark.parametrize("n", [1, 15, 16, 31, 32, 33, 500, 1003])
@pytest.mark.parametrize("spread", [2, 6, 1000])
def test_whole_subtrees_are_assigned_as_single_points(n, spread):
    """Small spreads make many ties, of points between entries and of entries that are equal."""
    rng = np.random.default_rng(n + spread)
    points, entries = rng.integers(-spread, spread, (n, 3)), rng.integers(-spread, spread, (16, 3))
    order, lo, hi, sums = vector_codes.plant(points)
    assert sorted(order) == list(range(n)) and (sums[0] == points.sum(0)).all()
    want = ((points[:, None] - entries[None]) ** 2).sum(-1).argmin(1)
    assert (vector_codes.codes_of(points[order], order, lo, hi, entries) == want).all()
    total = np.zeros((16, 3), np.int64)
    for first, _, entry, node in vector_codes.assign(points[order], lo, hi, entries):
        np.add.at(total, entry, points[order][first] if node is None else sums[node])
    assert (total == np.stack([points[want == e].sum(0) for e in range(16)])).all()


def test_trees_save_work():
    """Of clustered points most belong to subtrees that are assigned at once."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = (centres[rng.integers(0, 16, 4096)] + rng.integers(-100, 100, (4096, 8))).astype(np.int64)
    order, lo, hi, _ = vector_codes.plant(points)
    single = sum(len(first) for first, _, _, node in vector_codes.assign(points[order], lo, hi, centres) if node is None)
    assert single < 4096 / 2


def test_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [3e8] * 16, 1, "", 0, 0)], SCHEMA)).collect()

"""Outlines, pairs, sheets and their files against plain loops."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.functions import canvas, raster
from plumbline.operators import pictures
from plumbline.operators.reports import THUMB

BOX = "image long, class_id int, left double, top double, right double, bottom double"


def plain_outline(height, width, box, stroke=3):
    left, top, right, bottom = (int(x) for x in box)
    inside = lambda x, y, k: left + k <= x <= right - k and top + k <= y <= bottom - k
    return {(x, y) for x in range(width) for y in range(height) if inside(x, y, 0) and not inside(x, y, stroke)}


@pytest.mark.parametrize("box", [(2, 3, 20, 15), (-5.5, -3, 8.9, 40), (4, 4, 6, 6), (10, 10, 10, 10), (30, 3, 50, 9), (9, 9, 3, 3)])
def test_outlines(box):
    picture = np.zeros((18, 24, 3), np.uint8)
    canvas.outline(picture, box, (1, 2, 3))
    assert {(x, y) for y, x in zip(*np.nonzero(picture.any(2)), strict=True)} == plain_outline(18, 24, box)
    assert set(map(tuple, picture.reshape(-1, 3).tolist())) <= {(0, 0, 0), (1, 2, 3)}


@pytest.mark.parametrize("rows", [1, 7, 40, 100])
def test_files_of_bands(rows):
    picture = np.random.default_rng(rows).integers(0, 256, (40, 9, 3), dtype=np.uint8)
    data = b"".join(canvas.png(9, 40, (canvas.band(picture[at : at + rows], at + rows >= 40) for at in range(0, 40, rows))))
    assert (canvas.pixels(data) == picture).all()
    with pytest.raises(ValueError, match="damaged"):
        canvas.pixels(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_joined_checksums():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (1, 0), (0, 5), (70_000, 123), (3, 200_000)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert canvas.together(zlib.adler32(a), zlib.adler32(b), m) == zlib.adler32(a + b)


def test_pairs_and_sheet(spark):
    rng = np.random.default_rng(5)
    shapes = [(20, 40), (70, 30), (10, 10)]
    held = [rng.integers(0, 250, (h, w, 3), dtype=np.uint8) for h, w in shapes]
    df = spark.createDataFrame([(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in enumerate(held)], "image long, width int, height int, data binary")
    truths = spark.createDataFrame([(0, 1, 0.1, 0.1, 0.5, 0.9), (7, 1, 0.0, 0.0, 1.0, 1.0)], BOX)
    found = spark.createDataFrame([(0, 1, 0.2, 0.1, 0.6, 0.9, 0.5), (1, 0, 0.0, 0.0, 1.0, 1.0, 0.9)], BOX + ", conf double")
    drawn = pictures.pairs(df, truths, found)
    got = {r.image: canvas.pixels(bytes(r.png)) for r in pictures.as_png(drawn, rows=16).collect()}
    for i, p in enumerate(held):
        h, w = shapes[i]
        want = np.full((h + 24, 2 * w, 3), 255, np.uint8)
        want[24:, :w], want[24:, w:] = p, p
        if i == 0:
            for x, y in plain_outline(h, w, (0.1 * w, 0.1 * h, 0.5 * w, 0.9 * h)):
                want[24 + y, x] = canvas.TRUTH
        for x, y in {0: plain_outline(h, w, (0.2 * w, 0.1 * h, 0.6 * w, 0.9 * h)), 1: plain_outline(h, w, (0, 0, w, h)), 2: set()}[i]:
            want[24 + y, w + x] = canvas.FOUND
        assert (got[i] == want).all()
    ranked = df.withColumnRenamed("image", "rank").selectExpr("cast(rank as int) as rank", "width", "height", "data")
    sheet = canvas.pixels(b"".join(pictures.sheet_file(pictures.sheet_bands(ranked))))
    thumbs = [canvas.scaled(p, THUMB) for p in held]
    heights = [round(h * THUMB / w) for h, w in shapes]
    assert [t.shape for t in thumbs] == [(h, THUMB, 3) for h in heights] and sheet.shape == (max(heights[:2]) + heights[2], 2 * THUMB, 3)
    assert (sheet[: heights[0], :THUMB] == thumbs[0]).all() and (sheet[heights[0] : heights[1], :THUMB] == 255).all()
    assert (sheet[: heights[1], THUMB:] == thumbs[1]).all() and (sheet[heights[1] :, :THUMB] == thumbs[2]).all()
    assert b"".join(pictures.sheet_file(pictures.sheet_bands(ranked.limit(0)))) == b""
    assert (thumbs[2][..., 0] == raster.resample(held[2][..., 0], (THUMB, THUMB), raster.triangle, 1)).all()


def test_pictures_go_through_tasks_in_short_batches(spark, monkeypatch):
    """However many rows come in a batch, one picture is drawn or compressed at a time and about so many bytes leave together."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(pictures, "HELD", 250)
    seen = []

    def draw(r):
        seen.append(r["image"])
        return r["image"], r["data"]

    schema = pa.schema([("image", pa.int64()), ("data", pa.binary())])
    given = [pa.record_batch({"image": pa.array(range(k, k + 5), pa.int64()), "data": pa.array([b"x" * 100] * 5, pa.binary())}) for k in (0, 5)]
    out = pictures.each_picture(draw, schema)(iter(given))
    assert next(out).column("image").to_pylist() == [0, 1, 2] and seen == [0, 1, 2]
    assert [b.column("image").to_pylist() for b in out] == [[3, 4, 5], [6, 7, 8], [9]]
    spark.conf.unset(name)
    df = spark.createDataFrame([(1, 1, 1, b"abc")], "image long, width int, height int, data binary")
    pictures.as_png(df)
    assert spark.conf.get(name) == "4m"

"""Comparison pictures and contact sheets, drawn and compressed in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from plumbline.functions import canvas
from plumbline.functions.groups import short_batches
from plumbline.operators.detection import side_by_side
from plumbline.operators.reports import THUMB
from plumbline.sources.scratch import materialize

HELD = 1 << 20  # bytes of pictures that come out of a task together, unless one has more


def each_picture(f: Callable[[dict], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``f`` of one row at a time; the last value of what it gives has the picture's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size = 0
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            for i in range(batch.num_rows):
                made.append(f(batch.slice(i, 1).to_pylist()[0]))
                size += len(made[-1][-1])
                if size >= HELD:
                    yield as_batch()
                    made, size = [], 0
        if made:
            yield as_batch()

    return run


def decoded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(image, width, height, data) of picture files that Spark decodes: red, green and blue of each pixel."""
    read = spark.read.format("image").option("dropInvalid", "true").load(paths).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                flat = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgb = np.repeat(flat, 3, axis=2) if r["nChannels"] == 1 else flat[..., 2::-1]
                made.append((r["origin"], r["width"], r["height"], np.ascontiguousarray(rgb).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["image", "width", "height", "data"])

    held = read.mapInArrow(run, "image string, width int, height int, data binary")
    return held.withColumn("image", F.regexp_replace("image", "^file:///", "file:/"))


def pairs(pictures: DataFrame, truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """(image, width, height, data): each picture (image, width, height, data) with its true boxes beside itself with predicted ones.

    Boxes are (image, class_id, left, top, right, bottom) in shares of the picture, predictions with ``conf``; of boxes that cover each other the less
    sure one is drawn last. Pictures without boxes are drawn without; boxes without a picture aren't.
    """
    boxes = side_by_side(pictures, truths, predictions)
    pixels = lambda c: F.transform(c, lambda b: F.struct(*((b[k] * F.col(side)).alias(k) for k, side in (("left", "width"), ("top", "height"), ("right", "width"), ("bottom", "height")))))
    held = pictures.join(boxes, "image").select("image", "width", "height", "data", pixels("truths").alias("truths"), pixels("predictions").alias("predictions"))

    def draw(r: dict) -> tuple:
        drawn = canvas.pair(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3), *([tuple(b.values()) for b in r[k]] for k in ("truths", "predictions")))
        return r["image"], drawn.shape[1], drawn.shape[0], drawn.tobytes()

    short_batches(pictures.sparkSession)
    out = StructType([pictures.schema["image"], *(StructField(n, IntegerType()) for n in ("width", "height")), StructField("data", BinaryType())])
    return held.mapInArrow(each_picture(draw, to_arrow_schema(out)), out)


def as_png(pictures: DataFrame, rows: int = 256) -> DataFrame:
    """``pictures`` (.., width, height, data) with ``png`` in place of ``data``: whole files, compressed ``rows`` rows at a time."""

    kept = [f for f in pictures.schema if f.name != "data"]

    def file(r: dict) -> tuple:
        w, h = r["width"], r["height"]
        flat = np.frombuffer(r["data"], np.uint8).reshape(h, w, 3)
        bands = (canvas.band(flat[at : at + rows], at + rows >= h) for at in range(0, h, rows))
        return *(r[f.name] for f in kept), b"".join(canvas.png(w, h, bands))

    short_batches(pictures.sparkSession)
    out = StructType([*kept, StructField("png", BinaryType())])
    return pictures.mapInArrow(each_picture(file, to_arrow_schema(out)), out)


def sheet_bands(pictures: DataFrame, columns: int = 2) -> DataFrame:
    """(line, rows, compressed, checksum, length): the lines of a contact sheet of pictures (rank from 0, width, height, data), each compressed for itself.

    Pictures are scaled to one width and stand in lines as high as their highest, the rest white. A line is one task's; ``sheet_file`` joins them.
    """
    n = pictures.agg(F.max("rank").alias("n")).first().n
    final = -1 if n is None else n // columns
    lines = pictures.withColumn("line", F.floor(F.col("rank") / columns).cast("int"))

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        held = {r["rank"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3) for r in table.to_pylist()}
        thumbs = {rank % columns: canvas.scaled(picture, THUMB) for rank, picture in held.items()}
        sheet = np.full((max(t.shape[0] for t in thumbs.values()), columns * THUMB, 3), 255, np.uint8)
        for column, thumb in thumbs.items():
            sheet[: thumb.shape[0], column * THUMB : (column + 1) * THUMB] = thumb
        line = key[0].as_py()
        return pa.table({"line": [line], "rows": [sheet.shape[0]], **dict(zip(("compressed", "checksum", "length"), ([x] for x in canvas.band(sheet, line == final)), strict=True))}).cast(pa.schema([("line", pa.int32()), ("rows", pa.int32()), ("compressed", pa.binary()), ("checksum", pa.int64()), ("length", pa.int64())]))

    return lines.select("line", "rank", "width", "height", "data").groupBy("line").applyInArrow(draw, "line int, rows int, compressed binary, checksum long, length long")


def sheet_file(bands: DataFrame, columns: int = 2) -> Iterator[bytes]:
    """The pieces of the sheet's PNG file, from bands that pass through the driver one partition at a time, compressed; none without pictures."""
    held = materialize(bands, "sheet-bands")
    height = held.agg(F.sum("rows").alias("h")).first().h
    if height:
        in_order = held.orderBy("line").toLocalIterator()
        yield from canvas.png(columns * THUMB, height, ((bytes(r.compressed), r.checksum, r.length) for r in in_order))

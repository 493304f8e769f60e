"""Raster features of pictures: a 64-bit difference hash and the mean colour.

Spark's ``image`` source decodes; rasters in a column of bytes need no decoding. Resampling is two small matrix products a picture, with the filter widened by
the scale as is usual when pictures shrink. Grey levels and weights are whole numbers, as imaging libraries have them, so the result doesn't
depend on the order of sums. Decoders differ by a step of brightness here and there, so hashes of lossy pictures may differ in a bit from other tools'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

HASH_SIZE = (9, 8)  # fixed values: columns and rows of the grey raster, and of the colour raster
MEAN_SIZE = (32, 32)
LUMA = (19595, 38470, 7471)  # fixed values: shares of red, green and blue in grey, of 65536
BITS = 22  # of a weight's fraction


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


@lru_cache(maxsize=256)
def weights(n: int, to: int, kernel: Callable[[np.ndarray], np.ndarray], reach: float) -> np.ndarray:
    """The (to, n) matrix that resamples n places to ``to``, of whole numbers: each row sums to 2^``BITS`` or nearly so."""
    scale = n / to
    wide = max(scale, 1.0)
    centres = (np.arange(to) + 0.5) * scale
    away = (np.arange(n) + 0.5)[None, :] - centres[:, None]
    held = np.where(np.abs(away) < reach * wide, kernel(away / wide), 0.0)
    held /= held.sum(axis=1, keepdims=True)
    return (np.sign(held) * np.floor(np.abs(held) * (1 << BITS) + 0.5)).astype(np.int64)


def resample(channel: np.ndarray, size: tuple[int, int], kernel, reach: float) -> np.ndarray:
    """A (height, width) channel of bytes at another size, rounded to bytes after each direction, first across."""
    to_bytes = lambda a: np.clip((a + (1 << BITS - 1)) >> BITS, 0, 255)
    across = to_bytes(channel.astype(np.int64) @ weights(channel.shape[1], size[0], kernel, reach).T)
    return to_bytes(weights(channel.shape[0], size[1], kernel, reach) @ across)


def grey(rgb: np.ndarray) -> np.ndarray:
    """The brightness of each pixel."""
    return (rgb.astype(np.int64) @ LUMA + (1 << 15)) >> 16


def difference_hash(rgb: np.ndarray) -> int:
    """A bit for each neighbour to the right that is brighter, row by row, the first one highest; as a signed integer."""
    small = resample(grey(rgb), HASH_SIZE, lanczos, 3)
    return int(np.packbits(small[:, 1:] > small[:, :-1]).view(">i8")[0])


def mean_rgb(rgb: np.ndarray) -> list[float]:
    """The mean of each channel over the small raster."""
    return [float(resample(rgb[..., c], MEAN_SIZE, triangle, 1).mean()) for c in range(3)]


def sample_features(rasters: DataFrame, data: str, width: int, dhash: str = "dhash", colour: str = "mean_rgb") -> DataFrame:
    """``rasters`` with the hash and the mean colour of the picture in a column of bytes: red, green and blue of each pixel, rows of ``width`` pixels.

    A last row that isn't full is filled up with zeros. Null and empty pictures have neither.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, means = [], []
            for value in batch.column(data):
                held = value.as_py()
                if not held:
                    hashes.append(None)
                    means.append(None)
                    continue
                rgb = np.frombuffer(held + bytes(-len(held) % (3 * width)), np.uint8).reshape(-1, width, 3)
                hashes.append(difference_hash(rgb))
                means.append(mean_rgb(rgb))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64()), pa.array(means, pa.list_(pa.float64()))], [*batch.schema.names, dhash, colour])

    schema = StructType([*rasters.schema.fields, StructField(dhash, LongType()), StructField(colour, ArrayType(DoubleType()))])
    return rasters.mapInArrow(run, schema)


def _features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for path, height, width, channels, data in zip(part.image_path, part.height, part.width, part.nChannels, part["data"], strict=True):
            flat = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            rgb = np.repeat(flat, 3, axis=2) if channels == 1 else flat[..., 2::-1]
            out.append((path, difference_hash(rgb), mean_rgb(rgb)))
        yield pd.DataFrame(out, columns=["image_path", "dhash", "mean_rgb"])


def raster_features(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(image_path, dhash, mean_rgb) of every picture below the folders that can be decoded."""
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folders)
    flat = decoded.select("image.*").withColumnRenamed("origin", "image_path").select("image_path", "height", "width", "nChannels", "data")
    found = flat.mapInPandas(_features, "image_path string, dhash long, mean_rgb array<double>")
    # the image source says file:///a where listings say file:/a
    return found.withColumn("image_path", F.regexp_replace("image_path", "^file:///", "file:/"))

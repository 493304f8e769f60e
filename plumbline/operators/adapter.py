"""The local bilinear adapter's forward pass: of single pixels as array expressions, and of whole feature maps as matrix products in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

RANK, EPS = 64, 1e-6


def _matrix(weights) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in np.asarray(weights, float)))


def project(weights: Column, x: Column) -> Column:
    """A 1x1 convolution: each row of weights times the pixel's channels."""
    return F.transform(weights, lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def _checked(left, right, output) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right, output = (np.asarray(w, float) for w in (left, right, output))
    rank, channels = left.shape
    if rank <= 0 or channels <= 0 or right.shape != left.shape or output.shape != (channels, rank):
        raise ValueError("weights must be (rank, channels) twice and (channels, rank), with positive sizes")
    return left[:channels], right[:channels], output[:, :channels]


def bilinear_adapter(features: str | Column, left, right, output, scale: float = 1.0, eps: float = EPS) -> Column:
    """x plus the scaled projection of the normalised, signed-root product of two projections of x.

    ``left`` and ``right`` are (rank, channels), ``output`` is (channels, rank); with a zero ``output`` the result is x. A rank above the
    number of channels is cut to it.
    """
    left, right, output = _checked(left, right, output)
    x = F.transform(features, lambda v: v.cast("double"))
    product = F.zip_with(project(_matrix(left), x), project(_matrix(right), x), lambda a, b: a * b)
    rooted = F.transform(product, lambda z: F.signum(z) * F.sqrt(F.abs(z) + eps))
    # one element, so that the root is computed once and not for each use
    unit = F.transform(F.array(rooted), lambda z: F.transform(z, lambda v: v / F.greatest(F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, w: s + w * w)), F.lit(eps))))[0]
    back = F.transform(F.array(unit), lambda z: project(_matrix(output), z))[0]
    return F.zip_with(x, back, lambda a, b: a + F.lit(scale) * b)


def forward(x: np.ndarray, left: np.ndarray, right: np.ndarray, output: np.ndarray, scale: float, eps: float) -> np.ndarray:
    """The adapter of pixels (channels, n)."""
    product = (left @ x) * (right @ x)
    rooted = np.sign(product) * np.sqrt(np.abs(product) + eps)
    return x + scale * (output @ (rooted / np.maximum(np.sqrt((rooted**2).sum(0)), eps)))


def adapt_maps(maps: DataFrame, left, right, output, scale: float = 1.0, eps: float = EPS, branch=None, features: str = "features", result: str = "adapted") -> DataFrame:
    """``maps`` with ``result``: the adapter's output of each feature map, of the same size.

    A map is an array of numbers, channel after channel, each row by row; all that matters of its height and width is that they don't mix, so maps of
    different sizes may stand together. With ``branch``, (weights (classes, channels), bias (classes)), the adapted map goes on through
    that 1x1 convolution, and the result has a channel a class: the class branch with the adapter before it. Weights are broadcast once, and all pixels
    of a batch are one product. A null map, or one with a null, has a null result; an empty one an empty one. A length that isn't a multiple of the
    channels is an error.
    """
    left, right, output = _checked(left, right, output)
    channels = left.shape[1]
    head = None if branch is None else tuple(np.asarray(b, float) for b in branch)
    if head and (head[0].shape[1:] != (channels,) or head[1].shape != head[0].shape[:1]):
        raise ValueError("a branch is (classes, channels) and (classes)")
    if result in maps.columns:
        raise ValueError(f"{result} is a column already")
    held = maps.sparkSession.sparkContext.broadcast((left, right, output, scale, eps, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *weights, head = held.value
        for batch in batches:
            column = batch.column(features)
            lists = [None if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(float).reshape(channels, -1) for x in column]
            whole = [x for x in lists if x is not None]
            pixels = np.concatenate(whole, axis=1) if whole else np.zeros((channels, 0))
            done = forward(pixels, *weights)
            if head:
                done = head[0] @ done + head[1][:, None]
            parts = iter(np.split(done, np.cumsum([x.shape[1] for x in whole])[:-1], axis=1) if whole else [])
            made = [None if x is None else next(parts).ravel() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, result])

    return maps.mapInArrow(run, StructType([*maps.schema.fields, StructField(result, ArrayType(DoubleType()))]))

"""Column functions on perceptual hashes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = 8  # of eight bits each, in a 64-bit hash
COLOUR_GATE = 12.0  # largest difference of a mean channel


def difference_bits(values: str | Column) -> Column:
    """A hash of neighbour differences: bit set where the right value is larger, first pair in the highest bit."""
    v = F.col(values) if isinstance(values, str) else values
    rises = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: (b > a).cast("long"))
    return F.aggregate(rises, F.lit(0).cast("long"), lambda s, bit: F.shiftleft(s, 1).bitwiseOR(bit))


def grid_difference_hash(pixels: str | Column, width: int = 9) -> Column:
    """The difference hash of a row-major grey grid: each row's neighbours compared, rows from the top, highest bit first."""
    v = F.col(pixels) if isinstance(pixels, str) else pixels
    bit = lambda x, i: ((i + 1) % width != 0) & (F.element_at(v, (i + 2).cast("int")) > x)
    inner = F.filter(F.transform(v, lambda x, i: F.when((i + 1) % width == 0, F.lit(None)).otherwise(bit(x, i).cast("long"))), lambda b: b.isNotNull())
    return F.aggregate(inner, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def bands(bits: str | Column) -> Column:
    """The hash's eight bytes, lowest first."""
    b = F.col(bits) if isinstance(bits, str) else bits
    return F.array(*(F.shiftrightunsigned(b, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(BANDS)))


def hamming(a: str | Column, b: str | Column) -> Column:
    """The number of differing bits of two longs."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def largest_difference(a: str | Column, b: str | Column) -> Column:
    """The largest absolute difference of two arrays, element by element."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))

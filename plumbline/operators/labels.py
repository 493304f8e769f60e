"""Label lines to boxes, with a quarantine: every line gets its box or the code of the first rule that it breaks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Python's str.split and str.splitlines take for white space and line ends, and int and float for numbers.
BLANKS = r"[\s\x0b\x1c-\x1f\x85   -     　]+"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# a class and numbers; no part gives back what it took, so that a line is read once and a long polygon takes no stack
_DIGITS = r"[0-9]++(?:_[0-9]++)*+"
_NUMBER = rf"[+-]?+(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?+)?+|\.{_DIGITS})(?:[eE][+-]?+{_DIGITS})?+|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?+|[nN][aA][nN])"
TIDY = rf"\A[+-]?+{_DIGITS}(?: {_NUMBER})*+\z"  # as nearly all tools write it
NUMERIC = rf"\A(?:{BLANKS})?+[+-]?+{_DIGITS}(?:{BLANKS}+{_NUMBER})*+(?:{BLANKS})?+\z"
SPELT = (("_", ""), ("infinity", "inf"), ("inf", "Infinity"), ("nan", "NaN"))  # lower-cased numbers as the engine's own parser takes them at once
EVEN, ODD = (lambda _, i: i % 2 == 0), (lambda _, i: i % 2 == 1)  # a polygon's x and y


def split_lines(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (line_no from 1, line) for each line that isn't blank, beside the other columns."""
    each = texts.select("*", F.posexplode(F.split(text_col, LINE_ENDS)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return each.where(~F.col("line").rlike(f"^({BLANKS})?$")).drop(text_col)


def outline(points: str | Column) -> Column:
    """The box around a polygon (x, y, x, y, ...) as a struct of its centre x, y and size w, h.

    Least and greatest are found from left to right by comparisons that a NaN never passes, as Python's ``min`` and ``max`` do: a NaN counts only
    where it comes first, and then it stays.
    """
    v = F.col(points) if isinstance(points, str) else points
    xs, ys = (F.filter(v, one) for one in (EVEN, ODD))
    return F.struct(((_least(xs) + _most(xs)) / 2).alias("x"), ((_least(ys) + _most(ys)) / 2).alias("y"), (_most(xs) - _least(xs)).alias("w"), (_most(ys) - _least(ys)).alias("h"))


# To the engine a NaN is greater than any number: the least one passes it by, and the greatest is it wherever there is one.
def _least(a: Column) -> Column:
    return F.when(F.isnan(F.get(a, F.lit(0))), float("nan")).otherwise(F.array_min(a))


def _most(a: Column) -> Column:
    return F.when(F.isnan(F.get(a, F.lit(0))), float("nan")).otherwise(F.array_max(F.array_remove(a, float("nan"))))


def parse_lines(lines: DataFrame, classes: DataFrame, line_col: str = "line") -> DataFrame:
    """Add class_id, x_center, y_center, width, height and error to rows with a label line.

    ``classes`` has the known class_id. A line is a class and four numbers (a box) or a class and a polygon of three points or more, whose box
    is taken. Errors in the order in which they are looked for: not_numeric, class, polygon, non_finite, range, empty_box. Centre and
    size must be within [0, 1]; the box's edges may overhang. What must be finite is the box: see ``outline`` for what a polygon's NaN does to it.
    """
    at = lines.withColumn("_tidy", F.col(line_col).rlike(TIDY))
    at = at.withColumn("_numeric", F.col("_tidy") | F.col(line_col).rlike(NUMERIC))
    # with single spaces the engine splits without a pattern; all numbers are cast as one array, as functions of elements are interpreted
    text = F.lower(F.when(F.col("_tidy"), F.col(line_col)).otherwise(F.trim(F.regexp_replace(line_col, BLANKS, " "))))
    for seen, said in SPELT:
        text = F.replace(text, F.lit(seen), F.lit(said))
    at = at.withColumn("_t", F.when(F.col("_numeric"), F.split(text, " ")))
    at = at.withColumns({"_c": F.col("_t")[0].try_cast("bigint"), "_v": F.slice("_t", 2, 1 << 30).try_cast("array<double>")})
    known = classes.select(F.col("class_id").cast("long").alias("_k"), F.lit(True).alias("_known")).distinct()
    at = at.join(F.broadcast(known), F.col("_c") == F.col("_k"), "left")  # a dataset's class list
    box = F.size("_v") == 4
    polygon = (F.size("_v") >= 6) & (F.size("_v") % 2 == 0)
    at = at.withColumns({"_xs": F.when(polygon, F.filter("_v", EVEN)), "_ys": F.when(polygon, F.filter("_v", ODD))})
    at = at.withColumns({"_l": _least(F.col("_xs")), "_r": _most(F.col("_xs")), "_t": _least(F.col("_ys")), "_b": _most(F.col("_ys"))})
    around = {"_x": "(_l + _r) / 2", "_y": "(_t + _b) / 2", "_w": "_r - _l", "_h": "_b - _t"}
    at = at.withColumns({n: F.when(box, F.get("_v", F.lit(i))).when(polygon, F.expr(e)) for i, (n, e) in enumerate(around.items())})
    finite = reduce(and_, (F.abs(n) < float("inf") for n in ("_x", "_y", "_w", "_h")))  # a NaN is greater
    inside = F.col("_x").between(0.0, 1.0) & F.col("_y").between(0.0, 1.0) & F.col("_w").between(0.0, 1.0) & F.col("_h").between(0.0, 1.0)
    error = (
        F.when(~F.col("_numeric"), "not_numeric")
        .when(F.col("_known").isNull(), "class")
        .when(~box & ~polygon, "polygon")
        .when(~finite, "non_finite")
        .when(~inside, "range")
        .when((F.col("_w") <= 0) | (F.col("_h") <= 0), "empty_box")
    )
    at = at.withColumn("error", error)
    good = F.col("error").isNull()
    value = lambda c: F.when(good, F.col(c))
    out = {"class_id": F.when(good, F.col("_c").cast("int")), "x_center": value("_x"), "y_center": value("_y"), "width": value("_w"), "height": value("_h")}
    return at.withColumns(out).drop("_tidy", "_numeric", "_c", "_v", "_k", "_known", "_xs", "_ys", "_l", "_r", "_t", "_b", "_x", "_y", "_w", "_h")


def quarantine(parsed: DataFrame, *image: str, count: bool = False) -> DataFrame:
    """(image..., error, line_no) of every image with an error: that of its first bad line; with ``count`` also n_errors, how many it has."""
    first = [F.min_by("error", "line_no").alias("error"), F.min("line_no").cast("long").alias("line_no")]
    return parsed.where("error is not null").groupBy(*image).agg(*first, *([F.count("*").alias("n_errors")] if count else []))


def signature(box: Column) -> Column:
    """An aggregate: an image's boxes as one string, the same in whatever order its label file has them."""
    return F.to_json(F.array_sort(F.collect_list(box)))


def valid_boxes(parsed: DataFrame, *image: str) -> DataFrame:
    """The boxes of images without any error. ``parsed`` is read twice, so it should be a written table."""
    return parsed.join(parsed.where("error is not null").select(*image).distinct(), list(image), "left_anti").drop("error")

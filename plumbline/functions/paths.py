"""Column functions on dataset paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")  # fixed values: what counts as an image


def stem(path: str | Column) -> Column:
    """The file name without its last suffix; a leading dot alone isn't one."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: str | Column) -> Column:
    """The last suffix, lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]+)$", 1))


def parent_id(path: str | Column) -> Column:
    """The name that exported variants of one picture share: the stem up to the first ``.rf.``."""
    return F.substring_index(stem(path), ".rf.", 1)


def label_path(path: str | Column) -> Column:
    """The label's place under its root: the same path with ``.txt`` for the last suffix."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))


def is_image(path: str | Column) -> Column:
    return suffix(path).isin(*SUFFIXES)

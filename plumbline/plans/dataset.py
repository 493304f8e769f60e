"""Whole runs over a labelled image tree: the audit, and the leakage-free split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators import audit, split
from plumbline.sources import folders, sinks, tree
from plumbline.sources.scratch import materialize

DROPPED = 100  # fixed values: dropped files in a summary, and errors named when a run is refused
NAMED = 20


def _loaded(spark: SparkSession, root: str, near_threshold: int) -> tuple[tree.Layout, DataFrame, DataFrame, DataFrame]:
    layout = tree.discover(spark, root)
    records, boxes, errors = tree.records(spark, layout, raster=near_threshold >= 0)
    return layout, materialize(records, "records"), materialize(boxes, "boxes"), materialize(errors, "errors")


def _told(errors: DataFrame) -> DataFrame:
    """Errors as text, in order: the image, the line where there is one, and the rule that it breaks."""
    line = F.coalesce(F.concat(F.lit(":"), F.col("line_no").cast("string")), F.lit(""))
    return errors.orderBy("image_path").select(F.concat("image_path", line, F.lit(": "), "error").alias("told"))


def audit_tree(spark: SparkSession, root: str, report_path: str | None = None, near_threshold: int = 4) -> dict:
    """The audit's report. Near pictures are counted but never join components.

    The file at ``report_path`` has all errors, which stream into it; the dictionary has the first ``EXAMPLES`` and ``n_errors``. Leaking components and
    conflicts are the first ``EXAMPLES``, each with its number of files and the first ``FILES`` of them in record order. Of classes
    with one name the last id's counts are told.
    """
    layout, records, boxes, errors = _loaded(spark, root, near_threshold)
    grouped = materialize(audit.components(records, ["sha256", "parent_id"]), "grouped")
    found = sinks.one_row(audit.audit(records, boxes, tree.classes(spark, layout), errors, near_threshold, grouped))
    crossing = audit.cross_split_files(grouped).orderBy("component_id").collect()
    conflicting = audit.conflict_files(records, "sha256", "signature").orderBy("first").collect()
    by_name = lambda counts: {name: counts[str(i)] for i, name in sorted(layout.names.items())}
    told = _told(errors)
    report = {
        "dataset_root": layout.root,
        "yaml": layout.yaml,
        "classes": {str(i): n for i, n in layout.names.items()},
        "images_by_split": found["images_by_split"],
        "boxes_by_split": found["boxes_by_split"],
        "empty_images_by_split": found["empty_by_split"],
        "boxes_by_class": by_name(found["boxes_by_class"]),
        "images_by_class": by_name(found["images_by_class"]),
        "duplicate_pair_candidates": {k: found[k] for k in ("exact_pairs", "parent_pairs", "near_pairs")},
        "near_threshold": near_threshold,
        "near_duplicates_are_warning_only": True,
        "duplicate_components": found["duplicate_components"],
        "cross_split_duplicate_components": found["n_cross_split"],
        "cross_split_examples": [{"splits": r.splits.split(","), "n_files": r.n_records, "files": r.files} for r in crossing],
        "n_exact_image_annotation_conflicts": found["n_conflicts"],
        "exact_image_annotation_conflicts": [r.files for r in conflicting],
        "n_errors": found["n_errors"],
        "safe_for_training": found["safe"],
    }
    if report_path:
        sinks.write_report(spark, report, report_path, errors=told)
    return {**report, "errors": [r.told for r in told.limit(audit.EXAMPLES).collect()]}


def split_tree(spark: SparkSession, root: str, output: str, seed: int = 42, ratios: tuple[float, ...] = split.RATIOS, near_threshold: int = -1, drop_copies: bool = True) -> dict:
    """Write a tree below ``output`` whose splits share no duplicate group, and return what went where; ``split_manifest.json`` has that and a row an image.

    Images of all splits are dealt anew. Errors, conflicts, a split without images and an output that isn't empty refuse the run, in this order.
    """
    split.check_ratios(ratios)
    layout, records, boxes, errors = _loaded(spark, root, near_threshold)
    if bad := _told(errors).limit(NAMED).collect():
        raise ValueError("unreadable records: " + "; ".join(r.told for r in bad))
    if not audit.conflicts(records, "sha256", "signature").isEmpty():
        raise ValueError("equal images are annotated differently")
    near = audit.near_edges(records, near_threshold) if near_threshold >= 0 else None
    grouped = materialize(audit.components(records, ["sha256", "parent_id"], more_edges=near), "groups")
    counts = materialize(split.class_counts(grouped, boxes), "class-counts")
    assigned = materialize(split.assign(grouped, counts, seed, ratios, classes=sorted(layout.names)), "assigned")
    filled = {r.split for r in assigned.select("split").distinct().collect()}
    if missing := [s for s in split.SPLITS if s not in filled]:
        raise ValueError(f"no images for {', '.join(missing)}")
    sinks.must_be_empty(spark, output)
    held = grouped.withColumns({"stem": paths.stem("rel"), "suffix": paths.suffix("rel")})
    manifest = materialize(split.manifest(held, assigned, drop_copies), "manifest")
    images = {r.output_split: r["count"] for r in manifest.groupBy("output_split").count().collect()}
    groups = {r.split: r["count"] for r in assigned.groupBy("split").count().collect()}
    dropped = grouped.join(manifest.select(F.col("source_image").alias("image_path")), "image_path", "left_anti")
    in_order = lambda counts: {s: counts[s] for s in split.SPLITS if s in counts}
    report = {
        "source": layout.root,
        "output": output,
        "seed": seed,
        "near_threshold": near_threshold,
        "ratios": dict(zip(split.SPLITS, ratios, strict=True)),
        "images": in_order(images),
        "groups": in_order(groups),
        "dropped_exact_duplicates": records.count() - sum(images.values()),
        "dropped_files": [r[0] for r in dropped.select("image_path").orderBy("image_path").limit(DROPPED).collect()],
    }
    order = [split.split_rank("output_split"), F.col("assign_pos"), F.col("record_idx")]
    placed = manifest.join(grouped.select(F.col("image_path").alias("source_image"), "label_path", "record_idx", "component_id"), "source_image")
    placed = placed.join(assigned.select("component_id", "assign_pos"), "component_id")
    folders.write_tree(placed.repartitionByRange(*order).sortWithinPartitions(*order), output, report, sinks.class_list(output, layout.names))
    return report

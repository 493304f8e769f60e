"""What a model's run is to do, and the reports that runs leave: evaluations, screenings of two models, the audit of counted boxes.

Training and prediction are another program's, which leaves a table of predictions (image, class_id, x_center, y_center, width, height, conf), the image
told by its place below its split's folder of images. Metrics are found from those and the tree's labels, or come as rows (code, ord, key, value), a
few dozen a model; counts are rows of ``reports.count_errors``, which are as many as there are images and go to a folder of JSON lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import detection, pictures, reports
from plumbline.plans import dataset
from plumbline.sources import sinks, tree
from plumbline.sources.scratch import materialize

EVALUATED = ("val", "test")  # fixed values: splits that a model may be evaluated on
BY_CLASS, WORST = "map50_95_by_class", "worst_class_map50_95"  # fixed values: keys of a report's metrics


def next_step(spark: SparkSession, run_dir: str, resume: bool = True) -> str:
    """``skip`` for a run that ended, ``resume`` for one with last weights, else ``start``. Weights that may not be resumed refuse the run."""
    if sinks.is_complete(spark, run_dir):
        return "skip"
    if not sinks.exists(spark, f"{run_dir}/weights/last.pt"):
        return "start"
    if not resume:
        raise FileExistsError(f"{run_dir} has weights already")
    return "resume"


def screening_step(spark: SparkSession, run_dir: str, resume: bool = True) -> str:
    """``next_step`` of a screening, which takes a run with best weights for one that ended, whether or not its manifest is there."""
    return "skip" if sinks.exists(spark, f"{run_dir}/weights/best.pt") else next_step(spark, run_dir, resume)


def run_name(config: dict, seed: int) -> str:
    return f"{config['code']}_seed{seed}"


def training_arguments(config: dict, data_yaml: str, output_root: str, seed: int, device: str | None = None, resume: bool = False) -> dict:
    """A trainer's arguments: the configuration's own, overridden by what makes runs comparable; of a resumed run only that it is one."""
    forced = {"data": data_yaml, "project": output_root, "name": run_name(config, seed), "exist_ok": True, "seed": seed, "deterministic": True, "plots": True, "verbose": True}
    chosen = {"resume": True} if resume else {**config["train"], **forced}
    return chosen if device is None else {**chosen, "device": device}


def write_experiment(spark: SparkSession, run_dir: str, config_path: str, config: dict, data_root: str, data_yaml: str, seed: int, arguments: dict) -> dict:
    """The manifest of a run that ended; with it and its best weights the run counts as complete."""
    told = {k: config[k] for k in ("code", "variant", "model")}
    report = {"config": config_path, **told, "data": data_root, "data_yaml": data_yaml, "seed": seed, "train": arguments}
    sinks.write_json(spark, report, f"{run_dir}/experiment_manifest.json")
    return report


def metrics_of(metrics: DataFrame, per_class: DataFrame | None = None) -> dict:
    """One model's metrics as a report has them: numbers in their order, then by class name in class order, and the worst class.

    A value that isn't a number is an error. Of classes with one name the last counts.
    """
    found = {r.key: r.value for r in metrics.select("ord", "key", F.col("value").cast("double").alias("value")).orderBy("ord").collect()}
    if per_class is not None:
        classes = {r.name: r.value for r in per_class.select("class_id", "name", F.col("value").cast("double").alias("value")).orderBy("class_id").collect()}
        found[BY_CLASS] = classes
        if classes:
            found[WORST] = min(classes.values())
    return found


def evaluation(spark: SparkSession, output: str, checkpoint: str, data_root: str, metrics: DataFrame, per_class: DataFrame | None = None, split: str = "test") -> dict:
    """The report of one model on one split, written to ``output``."""
    if split not in EVALUATED:
        raise ValueError(f"a model is evaluated on {' or '.join(EVALUATED)}, not on {split}")
    report = {"checkpoint": checkpoint, "data": data_root, "split": split, "metrics": metrics_of(metrics, per_class)}
    sinks.write_json(spark, report, output)
    return report


def corners(boxes: DataFrame) -> DataFrame:
    """Boxes by centre and size as boxes by their corners, which detection metrics take."""
    half = {"left": F.col("x_center") - F.col("width") / 2, "top": F.col("y_center") - F.col("height") / 2, "right": F.col("x_center") + F.col("width") / 2, "bottom": F.col("y_center") + F.col("height") / 2}
    return boxes.withColumns(half).drop("x_center", "y_center", "width", "height")


def split_boxes(spark: SparkSession, layout: tree.Layout, split: str) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of one split of a tree: (image, image_path) and (image, class_id, left, top, right, bottom); unreadable records refuse it."""
    if split not in layout.splits:
        raise FileNotFoundError(f"{layout.root} has no split {split}")
    records, boxes, errors = tree.records(spark, tree.Layout(layout.root, layout.names, {split: layout.splits[split]}, layout.yaml))
    if bad := errors.limit(1).collect():
        raise ValueError(f"{bad[0].image_path}: {bad[0].error}")
    images = materialize(records.select("record_idx", F.col("rel").alias("image"), "image_path"), "split-images")
    return images.drop("record_idx"), materialize(corners(boxes.join(images.select("record_idx", "image"), "record_idx").select("image", "class_id", "x_center", "y_center", "width", "height")), "split-boxes")


def box_metrics(spark: SparkSession, truths: DataFrame, predictions: DataFrame, names: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """(metrics, per_class) from boxes by their corners: rows (ord, key, value), and (class_id, name, value) with the mean average precision of each class.

    Classes without a true box have no value of their own and don't count in the means, all of which are zero without any true box.
    """
    found = materialize(detection.average_precision(truths, predictions), "precision")
    means = detection.mean_precision(found).first()  # one row
    told = [("metrics/precision(B)", means.precision), ("metrics/recall(B)", means.recall), ("metrics/mAP50(B)", means.ap50), ("metrics/mAP50-95(B)", means.ap)]
    metrics = spark.createDataFrame([(i, k, float(v or 0.0)) for i, (k, v) in enumerate(told)], "ord int, key string, value double")
    classes = spark.createDataFrame(sorted(names.items()), "class_id int, name string")
    return metrics, classes.join(found.select("class_id", F.col("ap").alias("value")), "class_id")


def evaluate_tree(spark: SparkSession, root: str, predictions: DataFrame, checkpoint: str, output: str, split: str = "test") -> dict:
    """``evaluation`` of a table of predictions against the labels of one split of a tree."""
    if split not in EVALUATED:
        raise ValueError(f"a model is evaluated on {' or '.join(EVALUATED)}, not on {split}")
    layout = tree.discover(spark, root)
    _, truths = split_boxes(spark, layout, split)
    return evaluation(spark, output, checkpoint, layout.root, *box_metrics(spark, truths, corners(predictions), layout.names), split=split)


def baseline(spark: SparkSession, root: str, output_root: str, config: dict, seed: int, predictions: DataFrame, verified_audit: str | None = None) -> dict:
    """Audit, evaluation and summary of a run that ended. A tree that isn't safe, a stored audit of another one, or a run that didn't end refuse it, in this order."""
    audit_path = verified_audit or f"{output_root}/reports/dataset_audit.json"
    audited = sinks.verified_audit(spark, verified_audit, root) if verified_audit else dataset.audit_tree(spark, root, audit_path, near_threshold=-1)
    if not audited["safe_for_training"]:
        raise RuntimeError(f"the dataset isn't safe to train on: see {audit_path}")
    run_dir = f"{output_root}/{run_name(config, seed)}"
    if next_step(spark, run_dir) != "skip":
        raise FileNotFoundError(f"{run_dir} has no run that ended")
    evaluated = evaluate_tree(spark, root, predictions, f"{run_dir}/weights/best.pt", f"{output_root}/reports/{run_name(config, seed)}_test.json")
    return baseline_summary(spark, output_root, config, seed, root, audit_path, evaluated)


def screen_trees(spark: SparkSession, root: str, output_root: str, seed: int, predictions: dict[str, DataFrame]) -> dict:
    """Evaluations of models by code, in their order, their screening, and for two models whether the second one goes on."""
    layout = tree.discover(spark, root)
    _, truths = split_boxes(spark, layout, "test")
    report = {"seed": seed, "data_root": layout.root, "models": {}}
    found = {}
    for code, boxes in predictions.items():
        best = f"{output_root}/{code}_seed{seed}/weights/best.pt"
        if not sinks.exists(spark, best):
            raise FileNotFoundError(f"no best weights: {best}")
        one = corners(boxes)
        found[code] = materialize(detection.average_precision(truths, one), "precision")
        told = evaluation(spark, f"{output_root}/reports/{code}_seed{seed}_test.json", best, layout.root, *box_metrics(spark, truths, one, layout.names))
        report["models"][code] = told["metrics"]
    if len(found) == 2:
        a, b = found
        old, new = report["models"].values()
        keys = {"mAP50-95": "metrics/mAP50-95(B)", "mAP50": "metrics/mAP50(B)", "precision": "metrics/precision(B)", "recall": "metrics/recall(B)", WORST: WORST}
        delta = {k: new[m] - old[m] for k, m in keys.items() if m in old and m in new}
        decided = detection.screening_passes(found[a], found[b]).first()
        report["comparison"] = {"baseline": a, "candidate": b, "delta": delta, "passes": decided.passes}
    sinks.write_json(spark, report, f"{output_root}/reports/screening_seed{seed}.json")
    return report


def visual_audit(spark: SparkSession, root: str, output_root: str, predictions: DataFrame, checkpoint: str, samples: int = 12, seed: int = 42, confidence: float = 0.25) -> dict:
    """``counted_boxes`` of the test split; predictions below the confidence don't count. Of the picked images that can be decoded, the comparison with their
    boxes and a contact sheet are drawn, as PNG files."""
    layout = tree.discover(spark, root)
    images, truths = split_boxes(spark, layout, "test")
    sure = predictions.where(F.col("conf") >= confidence)
    rows = reports.count_errors(images, truths, sure).join(images, "image").drop("image").withColumnRenamed("image_path", "image")
    report = counted_boxes(spark, output_root, rows, checkpoint, layout.root, samples, seed, confidence)
    draw_picks(spark, output_root, report["selected"], images, truths, corners(sure))
    return report


def draw_picks(spark: SparkSession, output_root: str, picks: list[dict], images: DataFrame, truths: DataFrame, predictions: DataFrame) -> None:
    """A PNG file for each picked image at its ``comparison``, and ``contact_sheet.png`` of all; as many as samples, and none of images that aren't pictures."""
    if not picks:
        return
    named = spark.createDataFrame([(k, p["image"], p["comparison"]) for k, p in enumerate(picks)], "rank int, image_path string, target string")
    shown = pictures.decoded(spark, [p["image"] for p in picks]).withColumnRenamed("image", "image_path").join(named, "image_path").join(images, "image_path")
    held = materialize(shown.select("rank", "target", "image", "width", "height", "data"), "picked-pictures")
    drawn = materialize(pictures.pairs(held.select("image", "width", "height", "data"), truths, predictions).join(held.select("image", "rank", "target"), "image"), "drawn-pictures")
    for row in pictures.as_png(drawn).select("target", "png").toLocalIterator():
        sinks.write_bytes(spark, [bytes(row.png)], row.target)
    dense = drawn.drop("rank").withColumn("rank", (F.row_number().over(Window.orderBy("target")) - 1).cast("int"))  # of the picks; their names begin with their rank
    if held.count():
        sinks.write_bytes(spark, pictures.sheet_file(pictures.sheet_bands(dense)), f"{output_root}/contact_sheet.png")


def baseline_summary(spark: SparkSession, output_root: str, config: dict, seed: int, data_root: str, audit_path: str, evaluated: dict) -> dict:
    """What a baseline's run came to. Only the returned report says where it was written."""
    name = run_name(config, seed)
    paths = {"data_root": data_root, "checkpoint": evaluated["checkpoint"], "audit": audit_path, "test_report": f"{output_root}/reports/{name}_test.json"}
    report = {"code": config["code"], "model": config["model"], "seed": seed, **paths, "metrics": evaluated["metrics"]}
    return {**report, "summary": sinks.write_json(spark, report, f"{output_root}/reports/{name}_summary.json")}


def screening(spark: SparkSession, output_root: str, data_root: str, seed: int, metrics: DataFrame, codes: list[str]) -> dict:
    """The report over models' metrics in the order of ``codes``; two models are compared, the first being the baseline."""
    held = materialize(metrics.where(F.col("code").isin(codes)), "metrics")
    report = {"seed": seed, "data_root": data_root, "models": {c: metrics_of(held.where(F.col("code") == c)) for c in codes}}
    if len(codes) == 2:
        # the report's spelling of a metric's name is not that of the comparison's rows
        delta = {r.metric: r.delta for r in reports.model_delta(held, *codes).collect()}
        report["comparison"] = {"baseline": codes[0], "candidate": codes[1], "delta": {m.replace("map50", "mAP50") if m != WORST else m: delta[m] for m in reports.DELTAS if m in delta}}
    sinks.write_json(spark, report, f"{output_root}/reports/screening_seed{seed}.json")
    return report


def counted_boxes(spark: SparkSession, output_root: str, rows: DataFrame, checkpoint: str, data_root: str, samples: int = 12, seed: int = 42, confidence: float = 0.25) -> dict:
    """The report on images with a wrong number of boxes: totals and the picked images in ``visual_audit.json``, all rows in the folder ``rows``.

    ``rows`` are those of ``reports.count_errors``. Picked images carry the name that their comparison picture would have.
    """
    held = materialize(rows, "counted")
    held.write.mode("overwrite").json(f"{output_root}/rows")
    totals = sinks.one_row(reports.count_summary(held))
    picks = reports.select_for_audit(held, samples, seed)
    named = F.concat(F.lit(f"{output_root}/pairs/"), F.regexp_replace(reports.pair_name(F.col("pick") + 1, F.col("image")), "jpg$", "png"))
    selected = held.join(F.broadcast(picks), "image").withColumn("comparison", named).orderBy("pick").drop("pick")  # as many as samples
    report = {"checkpoint": checkpoint, "data_root": data_root, **totals, "confidence_threshold": confidence, "selected": [r.asDict() for r in selected.collect()]}
    sinks.write_json(spark, report, f"{output_root}/visual_audit.json")
    return report

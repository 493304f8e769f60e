"""What a run leaves behind: reports as JSON and class lists as YAML. Prepared trees are written by ``folders``."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tree import _store, read_text


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """A small text to any store; missing folders are made."""
    fs, at = _store(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return path


def write_bytes(spark: SparkSession, pieces, path: str) -> str:
    """A file of some pieces, one after the other; missing folders are made."""
    fs, at = _store(spark, path)
    stream = fs.create(at, True)
    try:
        for piece in pieces:
            stream.write(bytearray(piece))
    finally:
        stream.close()
    return path


def write_json(spark: SparkSession, payload, path: str) -> str:
    """JSON with two blanks a level, in UTF-8."""
    return write_text(spark, json.dumps(payload, indent=2, ensure_ascii=False, default=str), path)


def one_row(report: DataFrame) -> dict:
    """A one-row report as a dictionary; maps keep the order of their keys."""
    return json.loads(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()[0])


def class_list(root: str, names: dict[int, str]) -> str:
    """The text of a prepared tree's data.yaml, with its three splits."""
    spec = {"path": root, "train": "train/images", "val": "val/images", "test": "test/images", "names": names}
    return yaml.safe_dump(spec, sort_keys=False, allow_unicode=True)


def must_be_empty(spark: SparkSession, folder: str) -> None:
    """Raise unless the folder is missing or empty."""
    fs, at = _store(spark, folder)
    if fs.exists(at) and fs.listStatus(at):
        raise FileExistsError(f"{folder} isn't empty")


def write_report(spark: SparkSession, payload: dict, path: str, **streamed: DataFrame) -> str:
    """``write_json`` of a report that ends in lists as long as tables: the rows of each, which are one column, pass through the driver a partition at a time."""
    text = json.dumps(payload, indent=2, ensure_ascii=False, default=str)
    fs, at = _store(spark, path)
    stream = fs.create(at, True)
    put = lambda held: stream.write(bytearray("".join(held).encode("utf-8")))
    try:
        put([text[: text.rindex("}")].rstrip()])
        for key, rows in streamed.items():
            held, before = [f",\n  {json.dumps(key)}: ["], "\n    "
            for row in rows.toLocalIterator():
                held.append(before + json.dumps(row[0], ensure_ascii=False))
                before = ",\n    "
                if len(held) >= 4096:
                    put(held)
                    held = []
            put([*held, "]" if before == "\n    " else "\n  ]"])
        put(["\n}"])
    finally:
        stream.close()
    return path


def verified_audit(spark: SparkSession, path: str, root: str) -> dict:
    """A stored audit report that may be trained on: it is safe and of this tree; anything else is an error."""
    report = json.loads(read_text(spark, path))
    if not report.get("safe_for_training"):
        raise RuntimeError("the audit doesn't call this dataset safe")
    fs, at = _store(spark, root)
    if report.get("dataset_root") != str(at.toString()):
        raise RuntimeError("the audit is of another dataset")
    return report


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _store(spark, path)
    return fs.exists(at)


def is_complete(spark: SparkSession, run_dir: str) -> bool:
    """Whether a training run ended: its best weights, in its folder of weights, and its manifest are both there."""
    return exists(spark, f"{run_dir}/weights/best.pt") and exists(spark, f"{run_dir}/experiment_manifest.json")


def experiment(spark: SparkSession, path: str) -> dict:
    """An experiment's configuration: it needs code, variant, model and train, and one of the known variants."""
    spec = yaml.safe_load(read_text(spark, path))
    missing = {"code", "variant", "model", "train"} - set(spec)
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(sorted(missing))}")
    if spec["variant"] not in ("baseline", "local_hbp"):
        raise ValueError(f"unknown variant {spec['variant']}")
    return spec

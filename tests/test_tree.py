"""Whole runs over small image trees on disk: PNG files written here, labels, and every kind of defect."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import pytest

from plumbline.operators import audit
from plumbline.plans import dataset
from plumbline.sources import folders, sinks, tree


def png(grey: int, side: int = 24) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = (b"\0" + bytes([grey] * 3 * side)) * side
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def root(tmp_path):
    (tmp_path / "data.yaml").write_text("names: {0: normal, 1: defect}\n")
    for split, greys in {"train": (10, 30, 50), "valid": (80, 100), "test": (130, 160, 190)}.items():
        (tmp_path / split / "images").mkdir(parents=True)
        (tmp_path / split / "labels").mkdir()
        for i, grey in enumerate(greys):
            (tmp_path / split / "images" / f"{split}-{i}.png").write_bytes(png(grey))
            (tmp_path / split / "labels" / f"{split}-{i}.txt").write_text(f"{i % 2} 0.5 0.5 0.5 0.5\n")
    return tmp_path


def test_copy_across_splits(spark, root):
    (root / "test/images/duplicate.png").write_bytes(png(10))
    (root / "test/labels/duplicate.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    report = dataset.audit_tree(spark, f"file://{root}", f"file://{root}/out/report.json")
    assert report["images_by_split"] == {"train": 3, "val": 2, "test": 4} and report["boxes_by_class"] == {"normal": 6, "defect": 3}
    assert report["duplicate_pair_candidates"] == {"exact_pairs": 1, "parent_pairs": 0, "near_pairs": 1}
    assert (report["duplicate_components"], report["cross_split_duplicate_components"]) == (1, 1)
    assert [(e["splits"], e["n_files"], [f.rpartition("/")[2] for f in e["files"]]) for e in report["cross_split_examples"]] == [(["test", "train"], 2, ["train-0.png", "duplicate.png"])]
    assert not report["safe_for_training"]
    written = json.loads((root / "out/report.json").read_text())
    assert written == report and written["classes"] == {"0": "normal", "1": "defect"} and written["yaml"].endswith("/data.yaml")
    with pytest.raises(RuntimeError, match="safe"):
        sinks.verified_audit(spark, f"file://{root}/out/report.json", f"file://{root}")


def test_defects_are_quarantined_and_empty_files_kept(spark, root):
    labels = root / "train/labels"
    for name, text in {"train-0": b"", "train-1": b"0 0.5 0.5 0 0.5", "_train": b"0 0.5 0.5 0.5 0.5", "bad": b"\xff\xfe"}.items():
        (labels / f"{name}.txt").write_bytes(text)
    for name in ("_train.png", "bad.PNG", "alone.png"):
        (root / "train/images" / name).write_bytes(png(len(name)))
    (root / "train/images/folder.jpg").mkdir()
    (labels / "folder.txt").write_text("")
    records, boxes, errors = tree.records(spark, tree.discover(spark, f"file://{root}"))
    found = {r.image_path.rsplit("/", 1)[-1]: r.error for r in errors.collect()}
    assert found == {"train-1.png": "empty_box", "bad.PNG": "not_utf8", "alone.png": "label_missing", "folder.jpg": "not_a_file"}
    kept = {r.rel: r.record_idx for r in records.collect()}
    assert sorted(kept.values()) == list(range(8)) and "_train.png" in kept and kept["train-0.png"] < kept["valid-0.png"] < kept["test-0.png"]
    assert boxes.where(f"record_idx = {kept['train-0.png']}").isEmpty()


def test_report_names_files_classes_and_all_errors(spark, root, monkeypatch):
    """Equal pictures with other boxes, two classes of one name, files beyond those that are named, and errors beyond those that are returned."""
    monkeypatch.setattr(audit, "EXAMPLES", 2)
    (root / "data.yaml").write_text("names: {0: same, 1: same, 2: none}\n")
    for i in range(6):
        (root / f"train/images/copy-{i}.png").write_bytes(png(77))
        (root / f"train/labels/copy-{i}.txt").write_text(f"0 0.5 0.5 0.{i + 1} 0.5\n")
        (root / f"train/images/bad-{i}.png").write_bytes(png(i))
        (root / f"train/labels/bad-{i}.txt").write_text("0 0.5 0.5 0.5 0.5\n\n9 1 1 1 1\n")
    report = dataset.audit_tree(spark, f"file://{root}", f"file://{root}/report.json", near_threshold=-1)
    assert report["boxes_by_class"] == {"same": 3, "none": 0} and report["n_exact_image_annotation_conflicts"] == 1
    assert [[f.rpartition("/")[2] for f in files] for files in report["exact_image_annotation_conflicts"]] == [[f"copy-{i}.txt" for i in range(6)]]
    assert report["n_errors"] == 6 and len(report["errors"]) == 2
    written = json.loads((root / "report.json").read_text())
    assert [e.rpartition("/")[2] for e in written["errors"]] == [f"bad-{i}.png:3: class" for i in range(6)]
    records, _, _ = tree.records(spark, tree.discover(spark, f"file://{root}"))
    assert [(r.n_records, [f.rpartition("/")[2] for f in r.files]) for r in audit.conflict_files(records, "sha256", "signature", files=2).collect()] == [(6, ["copy-0.txt", "copy-1.txt"])]


def test_listing_follows_folders(spark, root):
    deep = root / "train/images/a b/c%20d/.hidden"
    deep.mkdir(parents=True)
    (deep / "x.png").write_bytes(png(1))
    (root / "train/images/a b/_y.png").write_bytes(b"")
    listed = {(r.split, r.kind, r.rel): (r.length, r.is_dir) for r in tree.listing(spark, tree.discover(spark, f"file://{root}")).collect()}
    assert listed["train", "image", "a b/c%20d/.hidden/x.png"] == (len(png(1)), False)
    assert listed["train", "image", "a b/_y.png"] == (0, False) and listed["train", "image", "a b/c%20d"][1]
    assert len([k for k in listed if k[1] == "label"]) == 8 and len(listed) == 8 + 8 + 5


def test_tasks_do_not_grow_with_files(spark, root, monkeypatch):
    """Many small files are dealt out among as many tasks as few, and a batch ends with the file that fills it."""
    monkeypatch.setattr(tree, "HELD", 100)
    for i in range(700):
        (root / f"train/images/many-{i}.png").write_bytes(b"%d" % (i // 2) * (i % 9))
        (root / f"train/labels/many-{i}.txt").write_text("" if i % 5 == 0 else f"{i % 2} 0.5 0.5 0.5 0.5\n" * (i % 5))
    context = spark.sparkContext
    context.setJobGroup("many-files", "")
    try:
        records, boxes, errors = tree.records(spark, tree.discover(spark, f"file://{root}"))
        hashes, n = {r.rel: r.sha256 for r in records.collect()}, boxes.count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert hashes["many-10.png"] == hashlib.sha256(b"5").hexdigest() and hashes["many-9.png"] == hashlib.sha256(b"").hexdigest()
    assert all(hashes[f"many-{i}.png"] == hashlib.sha256(b"%d" % (i // 2) * (i % 9)).hexdigest() for i in range(700))
    assert (len(hashes), n) == (708, 8 + sum(i % 5 for i in range(700))) and errors.isEmpty()
    seen = context.statusTracker()
    stages = [seen.getStageInfo(s) for job in seen.getJobIdsForGroup("many-files") for s in seen.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * context.defaultParallelism


def test_a_failed_copy_leaves_no_output(spark, root):
    rows = [(f"file:{root}/train/images/train-{i}.png", "train", f"file:{root}/train/labels/train-{i}.txt", f"train/images/train-{i}.png", "", "", "train", "group-000000") for i in (0, 1, 9)]
    out = root / "written"
    with pytest.raises(Exception, match="train-9"):
        folders.write_tree(spark.createDataFrame(rows, folders.WRITTEN).repartition(3), f"file:{out}", {"seed": 1}, "")
    assert [p.name for p in root.iterdir() if p.name.startswith("written")] == []
    folders.write_tree(spark.createDataFrame(rows[:2], folders.WRITTEN), f"file:{out}", {"seed": 1}, "names: []\n")
    assert json.loads((out / "split_manifest.json").read_text())["manifest"][1]["output_image"].endswith("/written/train/images/train-1.png")
    assert (out / "train/labels/train-0.txt").read_text() == "0 0.5 0.5 0.5 0.5\n"


def test_split_leaves_a_clean_tree(spark, root):
    out = root / "prepared"
    result = dataset.split_tree(spark, f"file://{root}", f"file://{out}", seed=7)
    assert sum(result["images"].values()) == 8 and len(result["images"]) == 3 and result["dropped_exact_duplicates"] == 0
    told = json.loads((out / "split_manifest.json").read_text())
    assert {k: v for k, v in told.items() if k != "manifest"} == result and result["ratios"] == {"train": 0.7, "val": 0.15, "test": 0.15}
    splits = [r["output_split"] for r in told["manifest"]]
    assert splits == sorted(splits, key=["train", "val", "test"].index) and len(splits) == 8
    assert set(told["manifest"][0]) == {"source_image", "source_split", "output_image", "sha256", "parent_id", "output_split", "group_id"}
    again = dataset.audit_tree(spark, f"file://{out}", near_threshold=-1)
    assert again["safe_for_training"] and again["errors"] == [] and sum(again["images_by_split"].values()) == 8
    with pytest.raises(FileExistsError):
        dataset.split_tree(spark, f"file://{root}", f"file://{out}", seed=7)


def test_layout_rules(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tree.discover(spark, f"file://{tmp_path}")
    assert tree.class_names({"names": ["a", "b"]}) == {0: "a", 1: "b"}
    with pytest.raises(ValueError, match="names"):
        tree.class_names({"names": "a"})


def test_runs_and_configurations(spark, tmp_path):
    (tmp_path / "weights").mkdir()
    (tmp_path / "weights" / "best.pt").write_bytes(b"x")
    assert not sinks.is_complete(spark, f"file://{tmp_path}")
    (tmp_path / "experiment_manifest.json").write_text("{}")
    assert sinks.is_complete(spark, f"file://{tmp_path}")
    (tmp_path / "e.yaml").write_text("code: D0\nvariant: other\nmodel: m\ntrain: {}\n")
    with pytest.raises(ValueError, match="variant"):
        sinks.experiment(spark, f"file://{tmp_path}/e.yaml")

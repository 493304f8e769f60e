"""Decisions and reports of runs, on small hand-worked tables."""

import json

import pytest

from plumbline.operators import reports
from plumbline.plans import runs

CONFIG = {"code": "D0", "variant": "baseline", "model": "m.pt", "train": {"epochs": 3, "seed": 7, "plots": False}}
METRICS = [
    ("A", 0, "metrics/precision(B)", 0.5),
    ("A", 1, "metrics/mAP50(B)", 0.75),
    ("A", 2, "metrics/mAP50-95(B)", 0.25),
    ("A", 3, "worst_class_map50_95", 0.125),
    ("B", 0, "metrics/precision(B)", 0.25),
    ("B", 1, "metrics/mAP50(B)", 1.0),
    ("B", 2, "metrics/mAP50-95(B)", 0.5),
]


def read(path):
    return json.loads(path.read_text(encoding="utf-8"))


def test_steps_of_a_run(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert runs.next_step(spark, f"{at}/none", resume=False) == "start"
    (tmp_path / "weights").mkdir()
    (tmp_path / "weights" / "last.pt").write_bytes(b"x")
    assert runs.next_step(spark, at) == "resume"
    with pytest.raises(FileExistsError):
        runs.next_step(spark, at, resume=False)
    (tmp_path / "weights" / "best.pt").write_bytes(b"x")
    assert runs.next_step(spark, at) == "resume"  # weights alone don't end a run
    args = runs.training_arguments(CONFIG, "d.yaml", "out", 42)
    runs.write_experiment(spark, at, "c.yaml", CONFIG, "root", "d.yaml", 42, args)
    assert runs.next_step(spark, at, resume=False) == "skip"
    assert read(tmp_path / "experiment_manifest.json") == {"config": "c.yaml", "code": "D0", "variant": "baseline", "model": "m.pt", "data": "root", "data_yaml": "d.yaml", "seed": 42, "train": args}


def test_arguments_are_forced_and_a_resumed_run_has_none():
    args = runs.training_arguments(CONFIG, "d.yaml", "out", 42, device="0")
    assert args == {"epochs": 3, "seed": 42, "plots": True, "data": "d.yaml", "project": "out", "name": "D0_seed42", "exist_ok": True, "deterministic": True, "verbose": True, "device": "0"}
    assert CONFIG["train"]["seed"] == 7
    assert runs.training_arguments(CONFIG, "d.yaml", "out", 42, resume=True) == {"resume": True}


def test_evaluation_and_summary(spark, tmp_path):
    metrics = spark.createDataFrame(METRICS, "code string, ord int, key string, value double").where("code = 'B'")
    classes = spark.createDataFrame([(1, "b", 0.5), (0, "a", 0.25), (2, "a", 0.75)], "class_id int, name string, value float")
    report = runs.evaluation(spark, f"file://{tmp_path}/e.json", "best.pt", "root", metrics, classes)
    assert report == read(tmp_path / "e.json")
    assert list(report["metrics"])[:3] == [m[2] for m in METRICS[4:]]
    assert report["metrics"]["map50_95_by_class"] == {"a": 0.75, "b": 0.5}
    assert report["metrics"]["worst_class_map50_95"] == 0.5
    with pytest.raises(ValueError, match="train"):
        runs.evaluation(spark, f"file://{tmp_path}/no.json", "best.pt", "root", metrics, split="train")
    summary = runs.baseline_summary(spark, f"file://{tmp_path}", CONFIG, 42, "root", "audit.json", report)
    written = read(tmp_path / "reports" / "D0_seed42_summary.json")
    assert "summary" not in written
    assert {k: v for k, v in summary.items() if k != "summary"} == written


def test_screening_compares_two_models(spark, tmp_path):
    metrics = spark.createDataFrame(METRICS, "code string, ord int, key string, value double")
    report = runs.screening(spark, f"file://{tmp_path}", "root", 42, metrics, ["A", "B"])
    assert report == read(tmp_path / "reports" / "screening_seed42.json")
    assert report["comparison"] == {"baseline": "A", "candidate": "B", "delta": {"mAP50-95": 0.25, "mAP50": 0.25, "precision": -0.25}}
    assert "comparison" not in runs.screening(spark, f"file://{tmp_path}", "root", 1, metrics, ["A"])


@pytest.mark.parametrize("n", [0, 5])
def test_counted_boxes(spark, tmp_path, n):
    rows = [(f"/d/im{i}.jpg", 3, 3 + i, i, 0.25 * i, 0.5) for i in range(n)]
    rows = spark.createDataFrame(rows, "image string, truth long, predicted long, error long, min_conf double, mean_conf double")
    report = runs.counted_boxes(spark, f"file://{tmp_path}", rows, "best.pt", "root", samples=2)
    assert report == read(tmp_path / "visual_audit.json")
    assert (report["images"], report["exact"], report["wrong"]) == (n, min(n, 1), max(n - 1, 0))
    assert [s["comparison"].rpartition("/")[2] for s in report["selected"]] == ["01_im4.png", "02_im3.png"][:n]
    assert spark.read.schema("image string").json(f"file://{tmp_path}/rows").count() == n


def test_names_and_captions(spark):
    df = spark.createDataFrame([(7, "/a/b.c.png", 0.125), (100, "x.jpg", 0.375), (3, "y", 1.0)], "rank long, image string, conf float")
    got = df.select(reports.pair_name("rank", "image").alias("p"), reports.caption("image", "conf").alias("c")).collect()
    assert [r.p for r in got] == ["07_b.c.jpg", "100_x.jpg", "03_y.jpg"]
    assert [r.c for r in got] == ["/a/b.c.png 0.12", "x.jpg 0.38", "y 1.00"]

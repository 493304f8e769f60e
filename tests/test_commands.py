"""The commands, from a tree with labels and a table of predictions to reports."""

from __future__ import annotations

import json

import pytest

from plumbline.__main__ import main
from plumbline.plans import runs

CONFIG = "code: {code}\nvariant: baseline\nmodel: m.pt\ntrain: {{epochs: 3}}\n"


@pytest.fixture
def place(spark, tmp_path):
    """A tree of three splits with unlike contents, two models' predictions and one ended run."""
    root = tmp_path / "tree"
    for split in ("train", "val", "test"):
        for kind in ("images", "labels"):
            (root / split / kind).mkdir(parents=True)
        for i in range(4):
            (root / split / "images" / f"{split}{i}.jpg").write_bytes(f"{split}{i}".encode())
            (root / split / "labels" / f"{split}{i}.txt").write_text("".join(f"{k} 0.{k + 2}5 0.5 0.2 0.3\n" for k in range(i % 3)))
    (root / "data.yaml").write_text("names: [a, b, c]\n")
    schema = "image string, class_id int, x_center double, y_center double, width double, height double, conf double"
    perfect = [(f"test{i}.jpg", k, 0.25 + k / 10, 0.5, 0.2, 0.3, 0.9 - i / 10) for i in range(4) for k in range(i % 3)]
    worse = [(image, k, x + (0.04 if k else 0.0), y, w, h, c) for image, k, x, y, w, h, c in perfect] + [("test0.jpg", 0, 0.5, 0.5, 0.1, 0.1, 0.95), ("test3.jpg", 0, 0.5, 0.5, 0.1, 0.1, 0.1)]
    for name, rows in (("perfect", perfect), ("worse", worse)):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}")
    for code in ("D0", "D1"):
        (tmp_path / f"{code}.yaml").write_text(CONFIG.format(code=code))
    weights = tmp_path / "out/D0_seed42/weights"
    weights.mkdir(parents=True)
    (weights / "best.pt").write_bytes(b"x")
    return tmp_path


def told(capsys):
    text = capsys.readouterr().out
    return json.loads(text[text.index("{") :])


def test_evaluate(spark, place, capsys):
    at = f"file://{place}"
    assert main(["evaluate", f"{at}/tree", f"{at}/e.json", "--checkpoint", "best.pt", "--predictions", f"{at}/perfect"]) == 0
    metrics = told(capsys)
    assert metrics["metrics/mAP50-95(B)"] == pytest.approx(1) and metrics["map50_95_by_class"] == pytest.approx({"a": 1.0, "b": 1.0})
    assert json.loads((place / "e.json").read_text())["metrics"] == metrics
    main(["evaluate", f"{at}/tree", f"{at}/w.json", "--checkpoint", "best.pt", "--predictions", f"{at}/worse"])
    worse = told(capsys)
    # the first found of class a is wrong; boxes of class b overlap their own by two thirds, which four of ten thresholds take
    assert worse["map50_95_by_class"]["a"] == pytest.approx(2 / 3, abs=0.01) and worse["map50_95_by_class"]["b"] == pytest.approx(0.4) and worse["metrics/mAP50(B)"] > worse["metrics/mAP50-95(B)"]


def test_training_plan_and_baseline(spark, place, capsys):
    at = f"file://{place}"
    args = ["train", f"{at}/tree", f"{at}/out", "--config", f"{at}/D0.yaml"]
    assert main(args) == 2 and told(capsys)["step"] == "start"
    assert main([*args, "--screening"]) == 0 and told(capsys) == {"step": "skip", "arguments": {}}
    with pytest.raises(FileNotFoundError, match="ended"):
        main(["baseline", f"{at}/tree", f"{at}/out", "--config", f"{at}/D0.yaml", "--predictions", f"{at}/perfect"])
    capsys.readouterr()
    (place / "out/D0_seed42/experiment_manifest.json").write_text("{}")
    assert main(["baseline", f"{at}/tree", f"{at}/out", "--config", f"{at}/D0.yaml", "--predictions", f"{at}/perfect", "--verified-audit", f"{at}/out/reports/dataset_audit.json"]) == 0
    assert told(capsys)["metrics/recall(B)"] == pytest.approx(1)
    assert json.loads((place / "out/reports/D0_seed42_summary.json").read_text())["audit"].endswith("dataset_audit.json")
    (place / "tree/test/images/copy.jpg").write_bytes(b"train0")
    (place / "tree/test/labels/copy.txt").write_text("")
    with pytest.raises(RuntimeError, match="safe"):
        main(["baseline", f"{at}/tree", f"{at}/out", "--config", f"{at}/D0.yaml", "--predictions", f"{at}/perfect"])
    assert main(["audit", f"{at}/tree", "--report", f"{at}/a.json", "--near-threshold", "-1"]) == 1


def test_screening(spark, place, capsys):
    at = f"file://{place}"
    with pytest.raises(FileNotFoundError, match="best"):
        main(["screening", f"{at}/tree", f"{at}/out", f"D0={at}/worse", f"D1={at}/perfect"])
    capsys.readouterr()
    (place / "out/D1_seed42/weights").mkdir(parents=True)
    (place / "out/D1_seed42/weights/best.pt").write_bytes(b"x")
    assert main(["screening", f"{at}/tree", f"{at}/out", f"D0={at}/worse", f"D1={at}/perfect"]) == 0
    found = told(capsys)
    assert found == json.loads((place / "out/reports/screening_seed42.json").read_text())
    assert found["comparison"]["passes"] and found["comparison"]["delta"]["mAP50-95"] == pytest.approx(1 - (2 / 3 + 0.4) / 2, abs=0.01)
    turned = runs.screen_trees(spark, f"{at}/tree", f"{at}/out", 42, {"D1": spark.read.parquet(f"{at}/perfect"), "D0": spark.read.parquet(f"{at}/worse")})
    assert not turned["comparison"]["passes"]


def test_visual(spark, place, capsys):
    at = f"file://{place}"
    assert main(["visual", f"{at}/tree", f"{at}/v", "--checkpoint", "best.pt", "--predictions", f"{at}/worse", "--samples", "2"]) == 0
    found = told(capsys)
    assert (found["images"], found["truth"], found["predicted"], found["exact"]) == (4, 3, 4, 3)
    picked = json.loads((place / "v/visual_audit.json").read_text())["selected"]
    assert picked[0]["image"].endswith("test0.jpg") and picked[0]["comparison"].endswith("01_test0.png")

"""``python -m plumbline COMMAND``: audit and split trees, plan runs, and report on what models found."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from plumbline.plans import dataset, runs
from plumbline.sources import sinks, tree

UNSAFE, UNFINISHED = 1, 2


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *places: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=text)
        for place in places:
            made.add_argument(place)
        made.add_argument("--seed", type=int, default=42)
        return made

    audit = command("audit", "report duplicates, leakage and conflicts of a tree", "root")
    audit.add_argument("--report", required=True)
    audit.add_argument("--near-threshold", type=int, default=4, help="differing bits of near pictures; negative: don't look for them")
    split = command("split", "write a tree whose splits share no duplicates", "root", "output")
    split.add_argument("--near-threshold", type=int, default=-1)
    split.add_argument("--keep-copies", action="store_true")
    train = command("train", "what the trainer is to do next, and its arguments", "root", "output")
    train.add_argument("--config", required=True)
    train.add_argument("--device")
    train.add_argument("--no-resume", action="store_true")
    train.add_argument("--screening", action="store_true", help="best weights alone end a run")
    evaluate = command("evaluate", "metrics of a table of predictions", "root", "output")
    evaluate.add_argument("--checkpoint", required=True)
    evaluate.add_argument("--predictions", required=True)
    evaluate.add_argument("--split", choices=runs.EVALUATED, default="test")
    baseline = command("baseline", "audit, evaluation and summary of a run that ended", "root", "output")
    baseline.add_argument("--config", required=True)
    baseline.add_argument("--predictions", required=True)
    baseline.add_argument("--verified-audit")
    screening = command("screening", "compare models, each given as CODE=PREDICTIONS", "root", "output")
    screening.add_argument("models", nargs="+")
    visual = command("visual", "images with a wrong number of boxes", "root", "output")
    visual.add_argument("--checkpoint", required=True)
    visual.add_argument("--predictions", required=True)
    visual.add_argument("--samples", type=int, default=12)
    visual.add_argument("--confidence", type=float, default=0.25)
    return parser


def main(args: list[str] | None = None) -> int:
    chosen = arguments().parse_args(args)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    boxes = lambda path: spark.read.parquet(path)
    show = lambda report: print(json.dumps(report, indent=2, ensure_ascii=False))
    if chosen.command == "audit":
        report = dataset.audit_tree(spark, chosen.root, chosen.report, chosen.near_threshold)
        show({k: v for k, v in report.items() if k in ("images_by_split", "boxes_by_split", "duplicate_pair_candidates", "cross_split_duplicate_components", "n_exact_image_annotation_conflicts", "n_errors", "safe_for_training")})
        return 0 if report["safe_for_training"] else UNSAFE
    if chosen.command == "split":
        show(dataset.split_tree(spark, chosen.root, chosen.output, chosen.seed, near_threshold=chosen.near_threshold, drop_copies=not chosen.keep_copies))
    elif chosen.command == "train":
        config = sinks.experiment(spark, chosen.config)
        decide = runs.screening_step if chosen.screening else runs.next_step
        step = decide(spark, f"{chosen.output}/{runs.run_name(config, chosen.seed)}", resume=not chosen.no_resume)
        plan = runs.training_arguments(config, tree.discover(spark, chosen.root).yaml, chosen.output, chosen.seed, chosen.device, step == "resume") if step != "skip" else {}
        show({"step": step, "arguments": plan})
        return 0 if step == "skip" else UNFINISHED
    elif chosen.command == "evaluate":
        show(runs.evaluate_tree(spark, chosen.root, boxes(chosen.predictions), chosen.checkpoint, chosen.output, chosen.split)["metrics"])
    elif chosen.command == "baseline":
        show(runs.baseline(spark, chosen.root, chosen.output, sinks.experiment(spark, chosen.config), chosen.seed, boxes(chosen.predictions), chosen.verified_audit)["metrics"])
    elif chosen.command == "screening":
        show(runs.screen_trees(spark, chosen.root, chosen.output, chosen.seed, {code: boxes(path) for code, _, path in (m.partition("=") for m in chosen.models)}))
    else:
        report = runs.visual_audit(spark, chosen.root, chosen.output, boxes(chosen.predictions), chosen.checkpoint, chosen.samples, chosen.seed, chosen.confidence)
        show({k: v for k, v in report.items() if k != "selected"})
    return 0


if __name__ == "__main__":
    sys.exit(main())

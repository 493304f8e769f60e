"""Audits of labelled image datasets, leakage-free splits and reports on experiments, as Spark jobs."""

from __future__ import annotations

from importlib import import_module
from typing import Any

__version__ = "0.3.0"

#: What users call, by the module that has it; a module is loaded when something of it is asked for.
_EXPORTS = {
    "audit_tree": "plumbline.plans.dataset",
    "split_tree": "plumbline.plans.dataset",
    "evaluate_tree": "plumbline.plans.runs",
    "baseline": "plumbline.plans.runs",
    "screen_trees": "plumbline.plans.runs",
    "visual_audit": "plumbline.plans.runs",
    "discover": "plumbline.sources.tree",
    "connected_components": "plumbline.operators.components",
    "near_pairs": "plumbline.operators.audit",
    "average_precision": "plumbline.operators.detection",
    "adapt_maps": "plumbline.operators.adapter",
}
__all__ = ["__version__", *_EXPORTS]


def __getattr__(name: str) -> Any:
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(_EXPORTS[name]), name)

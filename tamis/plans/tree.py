"""Many plans run as one tree: what they have in common is prepared once.

Plans that begin with the same stages, methods and degrees share a path from the root. A stage is fitted once per
path; all classifiers of a plan read one prepared table. The table of a stage is held while the plans below it run, and
released when the last of them is done, unless the stage is a ``LIGHT`` one: a projection of numbers costs its readers
less than a copy of the table, so these read it from the table held last, and its seconds count as theirs. Branches below
the root run side by side.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tamis.operators.convert import convert
from tamis.operators.score import evaluate
from tamis.operators.stages import STAGE_ORDER

Step = tuple[str, str, float]

# methods whose transform is a plain projection or filter, no heavier than reading its rows
LIGHT = {
    "imputation": {"DROP", "MEAN", "MEDIAN", "MF", "DUMMY"},
    "data_normalization": {"z_score", "robust", "min_max", "max_abs", "sigmoid"},
    "feature_selection": {"LC", "VAR", "Tree", "SVC", "MR", "WR"},
}


@dataclass
class Node:
    """A path of stages: the plans that end here and those that go on."""

    path: tuple[Step, ...] = ()
    plans: list = field(default_factory=list)
    children: dict[Step, Node] = field(default_factory=dict)

    def below(self) -> list:
        """All plans that pass here."""
        return self.plans + [p for c in self.children.values() for p in c.below()]


@dataclass(frozen=True)
class Outcome:
    """One classifier on one plan. ``reason`` says why there is no accuracy. The seconds of a shared stage count for every plan."""

    plan: object
    model: str
    accuracy: float | None = None
    f1: float | None = None
    n: int = 0
    prep_seconds: float = 0.0
    model_seconds: float = 0.0
    reason: str | None = None


def plan_tree(plans: list[tuple[object, dict, dict]]) -> Node:
    """``plans``: (name, methods by stage, degrees by stage); a stage without a method is skipped."""
    root = Node()
    for name, methods, degrees in plans:
        at = root
        for cls in STAGE_ORDER:
            if method := methods.get(cls.STAGE):
                step = (cls.STAGE, method, float(degrees.get(cls.STAGE, 1.0)))
                at = at.children.setdefault(step, Node((*at.path, step)))
        at.plans.append(name)
    return root


def run_plans(
    df: DataFrame, plans: list[tuple[object, dict, dict]], label: str, models: list[str], evaluation: str = "test",
    options: dict | None = None, parallel: int = 4, fitted: Callable[[tuple[Step, ...]], None] = lambda path: None,
) -> list[Outcome]:
    """Run all plans; one outcome per plan and classifier. ``fitted`` is told every path whose last stage is fitted.

    A stage that fails fails the plans below it, and no others.
    """
    stages = {cls.STAGE: cls for cls in STAGE_ORDER}
    root = plan_tree(plans)
    base = convert(df).persist(StorageLevel.MEMORY_AND_DISK)

    def failed(names: list, error: Exception, seconds: float) -> list[Outcome]:
        reason = f"{type(error).__name__}: {str(error)[:200]}"
        return [Outcome(name, m, prep_seconds=seconds, reason=reason) for name in names for m in models]

    def score(table: DataFrame, name: object, model: str, seconds: float) -> Outcome:
        started = time.perf_counter()
        try:
            result = evaluate(table, label, model, evaluation)
        except Exception as error:  # a failing classifier is an outcome of its own
            return failed([name], error, seconds)[models.index(model)]
        reason = None if result["accuracy"] is not None else "no score"
        return Outcome(name, model, result["accuracy"], result["f1"], result["n"], seconds, time.perf_counter() - started, reason)

    def grow(table: DataFrame, step: Step, node: Node, seconds: float) -> list[Outcome]:
        stage, method, degree = step
        started = time.perf_counter()
        held = None
        try:
            estimator = stages[stage](method, degree=degree, label=label, **(options or {}).get(stage, {}))
            estimator.hold = False  # the rows come from a table that is held
            fit = estimator.fit(table)
            fitted(node.path)
            done = fit.transform(table)
            if method not in LIGHT.get(stage, ()):
                held = done.persist(StorageLevel.MEMORY_AND_DISK)
                held.count()
        except Exception as error:
            if held is not None:
                held.unpersist()
            return failed(node.below(), error, seconds + time.perf_counter() - started)
        try:
            return visit(done, node, seconds + time.perf_counter() - started)
        finally:
            if held is not None:
                held.unpersist()

    def visit(table: DataFrame, node: Node, seconds: float) -> list[Outcome]:
        out = [score(table, name, m, seconds) for name in node.plans for m in models]
        for step, child in node.children.items():
            out += grow(table, step, child, seconds)
        return out

    try:
        out = [score(base, name, m, 0.0) for name in root.plans for m in models]
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            for part in pool.map(lambda item: grow(base, *item, 0.0), root.children.items()):
                out += part
    finally:
        base.unpersist()
    return out

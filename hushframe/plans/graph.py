"""Analyses as graphs: nodes are operators with arguments, which are values or other nodes.

validate() checks the whole graph without a Spark job (but for resize, even parts and lines through pairs, which count or
number rows); release() runs what is asked for in
as few jobs as there are row sets, charges the ledger once, and keeps what is released: asking again returns the same
values, and never draws again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from hushframe.operators import accuracy
from hushframe.operators.structure import released_column_bind, reshape
from hushframe.plans import planner
from hushframe.plans.frame import Aggregate, Noisy, PrivateFrame
from hushframe.plans.registry import OPERATORS
from hushframe.privacy import Charge, Definition, Ledger, PrivacyError, Usage, composed, effective, sequential
from hushframe.sources import readers

#: What released values may go through on the driver.
POST = {
    "add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": np.divide, "modulo": np.mod, "power": np.power, "negative": np.negative, "abs": np.abs,
    "row_max": np.fmax, "row_min": np.fmin, "equal": np.equal, "greater_than": np.greater, "less_than": np.less, "logical_and": np.logical_and, "logical_or": np.logical_or, "negate": np.logical_not,
    "log": lambda x, base=2.71828: np.log(x) / np.log(base), "reshape": reshape, "column_bind": lambda *x: np.array(released_column_bind(*x)),
}
#: What aggregates may go through before noise; their sensitivities follow.
AFFINE = ("add", "subtract", "multiply", "divide", "negative", "mix")


@dataclass(eq=False)
class Node:
    """A place in an analysis; operators chain on it."""

    analysis: Analysis = field(repr=False)
    id: int
    op: str
    args: tuple
    options: dict
    submission: int

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *a, **k: self.analysis.add(name, self, *a, **k)


class Analysis:
    """A graph over private data, with its privacy definition and ledger."""

    def __init__(self, spark: SparkSession, definition: Definition | None = None, limit: Usage | None = None, slack: float | None = None):
        self.spark, self.definition, self.ledger = spark, definition or Definition(), Ledger(limit, slack)
        self.nodes: list[Node] = []
        self.released: dict[int, object] = {}
        self._built: dict[int, object] = {}
        self.submission = 0

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *a, **k: self.add(name, *a, **k)

    def add(self, op: str, *args, **options) -> Node:
        if op not in OPERATORS and op not in POST and op not in AFFINE and op not in ("materialize", "literal", "dataframe", "parquet"):
            raise PrivacyError(f"there is no operator {op}")
        node = Node(self, len(self.nodes), op, args, options, self.submission)
        self.nodes.append(node)
        return node

    def submit(self) -> None:
        """Begins the next submission; budgets of all submissions add up."""
        self.submission += 1

    def _value(self, x):
        return self._build(x) if isinstance(x, Node) else [self._value(i) for i in x] if isinstance(x, list) else x

    def _build(self, node: Node):
        """The frame, aggregate, planned release or released value of a node."""
        if node.id in self.released:
            return self.released[node.id]
        if node.id not in self._built:
            args, options = [self._value(a) for a in node.args], {k: self._value(v) for k, v in node.options.items()}
            self._built[node.id] = self._apply(node, args, options)
        return self._built[node.id]

    def _apply(self, node: Node, args: list, options: dict):
        sources = {"materialize": readers.materialize, "literal": readers.literal, "parquet": readers.read_parquet}
        if node.op in sources:
            return sources[node.op](self.spark, *args, definition=self.definition, **options)
        if node.op == "dataframe":
            return readers.from_dataframe(*args, definition=self.definition, **options)
        inputs = [*args, *options.values()]
        if node.op in POST and not any(isinstance(x, (PrivateFrame, Aggregate)) for x in inputs):
            waiting = [x for x in inputs if isinstance(x, Noisy)]
            if waiting:
                return _Later(node)
            return _Later(node) if any(isinstance(x, _Later) for x in inputs) else POST[node.op](*args, **options)
        if any(isinstance(x, (Noisy, _Later)) for x in inputs):
            raise PrivacyError(f"{node.op} takes private data, not releases")
        if node.op in AFFINE and args and isinstance(args[0], Aggregate):
            return getattr(args[0], node.op)(*args[1:], **options)
        return OPERATORS[node.op](*args, **options)

    def validate(self) -> dict[int, str]:
        """The kind of every node; raises PrivacyError where the graph isn't private."""
        return {n.id: type(self._build(n)).__name__ for n in self.nodes}

    def properties(self, node: Node) -> dict:
        """What is known of a node's rows and columns."""
        x = self._build(node)
        if isinstance(x, PrivateFrame):
            return {"num_records": x.n, "c_stability": x.stability, "sample_proportion": x.sample, "is_not_empty": x.not_empty, "columns": x.props, "keys": [k.name for k in x.keys], "dataset_id": x.identity, "releasable": x.public}
        if isinstance(x, Aggregate):
            return {"aggregator": x.name, "sensitivity": x.sensitivity(1), "lower": x.lower, "upper": x.upper, "releasable": False}
        return {"releasable": True}

    def _planned(self) -> list[tuple[Node, Noisy]]:
        return [(n, x) for n in self.nodes if isinstance(x := self._build(n), Noisy)]

    def privacy_usage(self) -> Usage:
        """What all planned and done releases cost, as the ledger counts it: sums across submissions; within one, parts of a partition that are released apart cost as much as the dearest."""
        by_submission: dict[int, list[Charge]] = {}
        for n in self.nodes:
            x = self._built.get(n.id) if n.id in self.released else self._build(n)
            if isinstance(x, Noisy):
                by_submission.setdefault(n.submission, []).append(x.charge)
        return sequential(composed(c, self.ledger.slack) for c in by_submission.values())

    def release(self, *wanted: Node) -> dict[int, object]:
        """Values of nodes (all that can be released, if none is named). A value is drawn once."""
        todo = [(n, x) for n, x in self._planned() if n.id not in self.released and (not wanted or self._needed(n, wanted))]
        for n, x in todo:
            self.ledger.spend(f"{x.name}#{n.id}", x.charge[1], n.submission, x.charge[0])
        for (n, _), value in zip(todo, planner.release([x for _, x in todo])):
            self.released[n.id] = value
        for n in self.nodes:
            if isinstance(self._built.get(n.id), _Later):
                if all(i.id in self.released for i in _nodes([*n.args, *n.options.values()]) if isinstance(self._built.get(i.id), (Noisy, _Later))):
                    args, options = [self._value(a) for a in n.args], {k: self._value(v) for k, v in n.options.items()}
                    self.released[n.id] = POST[n.op](*[np.asarray(a) if isinstance(a, list) else a for a in args], **options)
        public = [(n, x) for n in (wanted or self.nodes) if n.id not in self.released and isinstance(x := self._build(n), (Aggregate, PrivateFrame)) and _frame(x).public]
        for n, x in public:  # public data leaves as it is: exact aggregates, and frames that are asked for
            if isinstance(x, Aggregate):
                exact = planner.evaluate([x])[0]
                self.released[n.id] = exact if x.frame.keys else exact[()]
            elif wanted:
                self.released[n.id] = x.df
        return {n.id: self.released[n.id] for n in (wanted or self.nodes) if n.id in self.released}

    def expand(self, node: Node) -> list[dict]:
        """What a planned release is made of: the exact aggregates, with what is proved of them and what their noise may use."""
        x = self._build(node)
        if not isinstance(x, Noisy):
            raise PrivacyError("only a private statistic or a mechanism can be expanded")
        out = []
        for (a, _), u in zip(x.parts, x.usages if len(x.usages) == len(x.parts) else [x.usage] * len(x.parts)):
            used = effective(u, a.frame.stability, a.frame.definition.group_size, a.frame.sample)
            norm = 2 if "gaussian" in x.mechanism.lower() else 1
            out.append({"aggregate": a.name, "columns": list(a.columns), "mechanism": x.mechanism, "sensitivity": a.sensitivity(norm), "epsilon": [used.epsilon], "delta": [used.delta], "paid": u})
        return out

    def _needed(self, node: Node, wanted: Sequence[Node]) -> bool:
        stack, seen = list(wanted), set()
        while stack:
            x = stack.pop()
            if x is node:
                return True
            if x.id not in seen:
                seen.add(x.id)
                stack += _nodes([*x.args, *x.options.values()])
        return False

    def report(self) -> str:
        """A JSON row for each released statistic."""
        rows = []
        for n in self.nodes:
            x = self._built.get(n.id)
            if n.id in self.released and isinstance(x, Noisy):
                rows.append(row(n.id, x, self.released[n.id]))
        return json.dumps(rows, default=_plain)


def _frame(x: Aggregate | PrivateFrame) -> PrivateFrame:
    return x.frame if isinstance(x, Aggregate) else x


class _Later:
    """Post-processing that waits for a release."""

    def __init__(self, node: Node):
        self.node = node


def _nodes(values) -> list[Node]:
    return [x for v in values for x in (_nodes(v) if isinstance(v, (list, tuple)) else [v]) if isinstance(x, Node)]


def _plain(x):
    return x.tolist() if isinstance(x, (np.ndarray, np.generic)) else str(x)


def row(node_id: int, x: Noisy, value) -> dict:
    """What a report says about a release."""
    u = x.usage
    return {
        "nodeID": node_id, "description": f"DP release of {x.name}", "statistic": x.name, "variables": list(x.parts[0][0].columns),
        "releaseInfo": {str(k): v for k, v in value.items()} if isinstance(value, dict) else value, "privacyLoss": {"name": "approximate", "epsilon": u.epsilon, "delta": u.delta},
        "mechanism": x.mechanism, "algorithmInfo": {k: v for k, v in x.arguments.items() if k != "candidates"}, "postprocess": len(x.parts) > 1,
    }


def privacy_usage_to_accuracy(x: Noisy, alpha: float) -> list[float]:
    """The accuracy of a planned release at confidence 1 - alpha, a number a column."""
    used = [u for u in x.usages for _ in range(len(x.arguments["sensitivity"]) // len(x.usages))]
    if x.mechanism == "Laplace":
        return [accuracy.laplace(s, u.epsilon, alpha) for s, u in zip(x.arguments["sensitivity"], used)]
    if x.mechanism == "SimpleGeometric":
        return [accuracy.geometric(s, u.epsilon, alpha) for s, u in zip(x.arguments["sensitivity"], used)]
    if x.mechanism in ("Gaussian", "AnalyticGaussian"):
        return [accuracy.gaussian(s, u.epsilon, u.delta, alpha, x.mechanism != "Gaussian") for s, u in zip(x.arguments["sensitivity"], used)]
    if x.mechanism == "Snapping":
        return [accuracy.snapping(s, u.epsilon, alpha, a, b) for s, u, a, b in zip(x.arguments["sensitivity"], used, x.arguments["lower"], x.arguments["upper"])]
    raise PrivacyError(f"the accuracy of the {x.mechanism} mechanism has no closed form")


def accuracy_to_privacy_usage(mechanism: str, sensitivity: float, wanted: float, alpha: float, delta: float = 0.0, lower: float | None = None, upper: float | None = None) -> Usage:
    kind = mechanism.lower()
    if kind in ("laplace", "simplegeometric"):
        return accuracy.laplace_usage(sensitivity, wanted, alpha)
    if kind in ("gaussian", "analyticgaussian"):
        return accuracy.gaussian_usage(sensitivity, wanted, delta, alpha, kind != "gaussian")
    if kind == "snapping":
        return accuracy.snapping_usage(sensitivity, wanted, alpha, lower, upper)
    raise PrivacyError(f"unknown mechanism {mechanism}")

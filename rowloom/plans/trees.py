"""Tree ensembles evaluated inside the JVM, from a table of their nodes."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from rowloom.functions import name_of, require_columns, value_of
from rowloom.plans.scoring import Scorer


@dataclass(frozen=True)
class Node:
    """A split, or a leaf if it has no feature.

    A row goes left if its value is less than the threshold; a missing value or
    NaN goes left if ``missing_left``. Leaves carry a value.
    """

    tree: int
    node: int
    feature: str | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    missing_left: bool | None = None
    value: float | None = None


NODE_TABLE = (
    "tree int, node int, feature string, threshold double, left int, right int,"
    " missing_left boolean, value double"
)
ROOT = 0


class TreeModel:
    """The sum of the trees' leaf values and a base, by default as a logistic score.

    Bounded by the model, never by rows: the nodes live on the driver and in
    the plan. Trees are checked when the model is made: each has a root 0, and
    every other node is the child of exactly one.
    """

    def __init__(self, nodes: Iterable[Node], base: float = 0.0, scale: float = 1.0, logistic: bool = True):
        self.base, self.scale, self.logistic = float(base), float(scale), logistic
        self.trees: dict[int, dict[int, Node]] = defaultdict(dict)
        for n in nodes:
            if n.node in self.trees[n.tree]:
                raise ValueError(f"tree {n.tree} has two nodes {n.node}")
            self.trees[n.tree][n.node] = n
        for tree, members in self.trees.items():
            self._check(tree, members)

    @staticmethod
    def _check(tree: int, members: dict[int, Node]) -> None:
        seen, open_nodes = set(), [ROOT]
        while open_nodes:
            at = open_nodes.pop()
            if at in seen or at not in members:
                raise ValueError(f"tree {tree} has no node {at} or reaches it twice")
            seen.add(at)
            n = members[at]
            if n.feature is None:
                if n.value is None or not math.isfinite(n.value):
                    raise ValueError(f"leaf {at} of tree {tree} has no value")
            elif n.threshold is None or n.left is None or n.right is None:
                raise ValueError(f"split {at} of tree {tree} is not complete")
            else:
                open_nodes += [n.left, n.right]
        if len(seen) < len(members):
            raise ValueError(f"tree {tree} has nodes that can't be reached")

    @property
    def features(self) -> list[str]:
        return sorted({n.feature for t in self.trees.values() for n in t.values() if n.feature})

    def tree_sql(self, tree: int) -> str:
        """One tree as nested conditions, each evaluated only on the way of a row."""
        members = self.trees[tree]

        def text(at: int) -> str:
            n = members[at]
            if n.feature is None:
                return value_of(float(n.value))
            # NaN is greater than any number here, as a missing value it has its own way.
            x = f"nanvl(CAST({name_of(n.feature)} AS DOUBLE), NULL)"
            goes_left = f"coalesce({x} < {value_of(float(n.threshold))}, {value_of(bool(n.missing_left))})"
            return f"CASE WHEN {goes_left} THEN {text(n.left)} ELSE {text(n.right)} END"

        return text(ROOT)

    def margin_sql(self, trees: Sequence[int] | None = None) -> str:
        chosen = sorted(self.trees) if trees is None else trees
        return " + ".join(["0D", *[self.tree_sql(t) for t in chosen]])

    def scorer(self, nodes_at_once: int = 2_000) -> Scorer:
        """Adds ``prob``, as the other scorers do.

        Groups of trees with about ``nodes_at_once`` nodes are summed one after
        the other: each is an expression of its own, small enough to be
        compiled, whose sum an array keeps apart from the next.
        """
        groups: list[list[int]] = [[]]
        size = 0
        for tree, members in sorted(self.trees.items()):
            if size + len(members) > nodes_at_once and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append(tree)
            size += len(members)

        def score(df: DataFrame) -> DataFrame:
            require_columns(df, self.features)
            sums = ", ".join(self.margin_sql(g) for g in groups)
            total = f"aggregate(array({sums}), {value_of(self.base)}, (a, x) -> a + x)"
            total = f"({total}) * {value_of(self.scale)}"
            return df.selectExpr("*", f"1.0D / (1.0D + exp(-({total}))) AS prob" if self.logistic else f"{total} AS prob")

        return score

    def save(self, spark: SparkSession, folder: str) -> None:
        nodes = [astuple(n) for t in self.trees.values() for n in t.values()]
        spark.createDataFrame(nodes, NODE_TABLE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes")
        head = [(self.base, self.scale, self.logistic)]
        spark.createDataFrame(head, "base double, scale double, logistic boolean").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{folder}/link")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TreeModel:
        link = spark.read.parquet(f"{folder}/link").head()
        return cls(nodes_of(spark.read.parquet(f"{folder}/nodes")), link["base"], link["scale"], link["logistic"])


def nodes_of(table: DataFrame) -> list[Node]:
    """The nodes of a node table."""
    names = [f.split()[0] for f in NODE_TABLE.split(", ")]
    return [Node(*r) for r in table.select(*names).collect()]


def from_spark_ml(model, features: Sequence[str]) -> TreeModel:
    """The node table of a fitted Spark ML gradient-boosted classifier over numeric features.

    ``features`` names the parts of its vector. Spark splits at 'at most', which
    is 'less than the next number'; missing values, which Spark ML does not
    take, go right, where NaN goes.
    """
    nodes: list[Node] = []

    def walk(tree: int, java, weight: float) -> int:
        at = sum(1 for n in nodes if n.tree == tree)
        nodes.append(Node(tree, at))  # keeps the place
        slot = len(nodes) - 1
        if java.subtreeDepth() == 0:
            nodes[slot] = Node(tree, at, value=java.prediction() * weight)
        else:
            split = java.split()
            threshold = math.nextafter(split.threshold(), math.inf)
            left = walk(tree, java.leftChild(), weight)
            right = walk(tree, java.rightChild(), weight)
            name = features[split.featureIndex()]
            nodes[slot] = Node(tree, at, name, threshold, left, right, False)
        return at

    for tree, (part, weight) in enumerate(zip(model.trees, model.treeWeights)):
        walk(tree, part._java_obj.rootNode(), weight)
    return TreeModel(nodes, scale=2.0)

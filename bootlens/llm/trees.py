"""Tree ensembles of Spark ML as Column expressions.

An ensemble is fitted by Spark ML on a bounded labelled sample and then
written out as nested CASE expressions, so that scoring is a projection of
native expressions and can stand inside a lambda over an array.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_SPLIT = re.compile(r"\s*(If|Else) \(feature (\d+) (<=|>|in|not in) ([^)]*)\)")


def parse_tree(text: str):
    """Nested (feature, threshold, low, high) or a leaf's value, from a tree's ``toDebugString``."""
    lines = [x for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if "Predict:" in line:
            return float(line.split("Predict:")[1])
        kind, feature, op, threshold = _SPLIT.match(line).groups()
        if kind != "If" or op != "<=":
            raise ValueError(f"not a split of a continuous feature: {line}")
        low = node()
        at += 1  # the matching Else
        return int(feature), float(threshold), low, node()

    return node()


def tree_value(tree, features: Sequence[Column]) -> Column:
    """Value of a parsed tree for a row of feature columns."""
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(features[feature] <= F.lit(threshold), tree_value(low, features)).otherwise(tree_value(high, features))


def boosted_margin(model, features: Sequence[Column]) -> Column:
    """Margin of a gradient-boosted classifier; positive means class 1."""
    return sum((F.lit(float(w)) * tree_value(parse_tree(t.toDebugString), features) for t, w in zip(model.trees, model.treeWeights)), F.lit(0.0))


def forest_votes(model, features: Sequence[Column]) -> Column:
    """Share of a forest's trees that vote for class 1."""
    return sum((tree_value(parse_tree(t.toDebugString), features) for t in model.trees), F.lit(0.0)) / float(len(model.trees))

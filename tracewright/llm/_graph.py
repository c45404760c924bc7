"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._session import cut


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex of the component of each of n vertices, over links between a and b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """vertex and component (its smallest vertex) of all vertices of links a, b.

    Labels go to neighbours and, at each turn, to the label of a label, so that turns grow with the logarithm of the
    longest path. A hub only receives the smallest of its labels, which is summed up before rows are dealt.
    """
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("vertex"), F.least("a", "low").alias("component"))
    labels = cut(labels)
    while True:
        near = both.join(labels, both["b"] == labels["vertex"]).groupBy("a").agg(F.min("component").alias("near"))
        told = labels.join(near, labels["vertex"] == near["a"]).select("vertex", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("vertex").alias("mid"), F.col("component").alias("jump"))
        new = cut(told.join(up, "mid", "left").select("vertex", "old", F.least("mid", F.coalesce("jump", "mid")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("vertex", "component")
        if not changed:
            return labels

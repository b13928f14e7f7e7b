"""Connected components of a table of links. Only small tables are gathered, as for a broadcast; the rest is not."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stage


#: Links, of two long ids each, up to which the driver joins them; a round over a table costs several shuffles, however small it is.
GATHERED = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of the links' nodes: roots are hung below smaller ones, then each node below its root, until no link
    has two roots."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root := label[label], label):
            label = root


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): each linked node with the smallest node of its component.

    Up to GATHERED links are joined in the driver. Of more, each round takes the smallest label among a node's
    neighbours, then the label of its label, so a chain of n links takes about log n rounds. A round's labels are a
    written table.
    """
    links = stage(links.select("a", "b"), "pairs")
    if links.count() <= GATHERED:
        got = links.toArrow()
        node, label = joined(*(np.array(got.column(c).to_numpy(), dtype=np.int64) for c in ("a", "b")))
        return stage(links.sparkSession.createDataFrame(pa.table({"node": node, "label": label})), "labels")
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(new.join(jump, "label", "left").select("node", "old", F.coalesce("far", "label").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels

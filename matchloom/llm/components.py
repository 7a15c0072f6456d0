"""Connected components of a link table, by contraction.

Each round every node that still has links hooks on to its smallest neighbour if that is smaller, follows that
neighbour's own hook once, and the links are rewritten between the nodes arrived at. Nodes with links at least
halve, so rounds grow with the logarithm of the largest component. The state of each round is a written table;
nothing but the number of links left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_scratch, materialise


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns a and b); nodes share a root if and only if linked.

    Self-links, repeated links and either direction are fine; no links give no rows.
    """
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = materialise(ordered(links), "links")
    roots, size = None, 0
    while count := left.count():
        ends = 2 * count
        size = size or ends
        near = left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(
            left.select(F.col("a").alias("node"), F.col("a").alias("to"))
        )
        hooks = materialise(near.groupBy("node").agg(F.min("to").alias("to")), "hooks", ends)
        onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("root"))
        jumped = materialise(hooks.join(onward, "to").select("node", "root"), "jumped", ends)
        a = jumped.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = jumped.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        after = materialise(ordered(left.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links", count)
        if roots is None:
            grown = jumped
        else:
            step = jumped.select(F.col("node").alias("root"), F.col("root").alias("next"))
            grown = materialise(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots", size)
            drop_scratch(roots)
            drop_scratch(jumped)
        drop_scratch(left)
        drop_scratch(hooks)
        left, roots = after, grown
    return links.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots

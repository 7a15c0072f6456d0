"""Components of all pairs that meet in a bucket and are near, without listing the pairs of large buckets.

Buckets of at most ``FEW`` nodes compare all their pairs. Nodes that larger ones bring together, in however many of
them, are a crowd. In a crowd each node is first compared with the one before it and the first. Crowds that then still
hold several components are compared in full, once: those outside a crowd's largest component meet each other and all
of it, dealt out in blocks of about ``BLOCK`` nodes, and a kernel compares the pairs of a block whose ends are in
different components. Its links number at most the nodes of the block, so rows don't grow with the pairs, and no pair
that meets is left out unless its ends are linked already. Crowds of more than ``CROWD`` nodes, which buckets may chain
together, are compared by bucket instead.

A caller lists ``first_pairs`` of ``small`` buckets and of ``groups``, checks them, and passes the links to ``roots``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop_scratch, forget, materialise
from .components import components

FEW, BLOCK, CROWD, SALTED, AT_ONCE = 8, 256, 20_000, 1024, 64

#: Given the payloads of a block: a function from a place in it and other places to a mask of those that are near.
Kernel = Callable[[list], Callable[[int, np.ndarray], np.ndarray]]


def small(met: DataFrame) -> DataFrame:
    """Those of ``met`` (bucket, node, n) whose bucket's pairs are all among the first ones."""
    return met.where(F.col("n") <= FEW)


def groups(met: DataFrame, most: int = CROWD) -> DataFrame:
    """``bucket, node, n``: the crowds that larger buckets make, or the buckets themselves of too large crowds.

    A crowd is named by its least node: each round a bucket takes the least name among its nodes, and a node that of
    its buckets, until none changes; rounds number as the steps from one end of a crowd to the other.
    """
    crowded = met.where(F.col("n") > FEW).select("bucket", "node", "n")
    count = crowded.count()
    state = materialise(crowded.withColumn("name", F.col("node")), "crowds", count)
    while True:
        least = state.select("bucket", "node", "n", "name", F.min("name").over(Window.partitionBy("bucket")).alias("low"))
        after = materialise(least.select("bucket", "node", "n", "name", F.min("low").over(Window.partitionBy("node")).alias("next")), "crowds", count)
        drop_scratch(state)
        state = after.select("bucket", "node", "n", F.col("next").alias("name"))
        if not after.where("next < name").head(1):
            break
    members = state.groupBy("name", "node").agg(F.count("*").alias("buckets")).select("name", "node")
    sized = materialise(members.withColumn("size", F.count("*").over(Window.partitionBy("name"))), "members", count)
    out = sized.where(F.col("size") <= most).select(F.col("name").alias("bucket"), "node", F.col("size").alias("n"))
    huge = sized.where(F.col("size") > most).select("node")
    return out.unionByName(crowded.join(huge, "node").select("bucket", "node", "n")) if huge.head(1) else out


def first_pairs(met: DataFrame, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``node, before``, distinct, of ``met`` (bucket, node, n): all pairs of small buckets, a few of large ones; with
    ``near``, those for which it holds about the column ``tag`` of the two."""
    met = met if near else met.withColumn("tag", F.lit(None).cast("int"))
    few = F.col("n") <= FEW
    dealt = met.withColumn("salt", F.when(few, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SALTED))).cast("long"))
    order, own = Window.partitionBy("bucket", "salt").orderBy("node"), F.struct("node", "tag")
    back = [F.lag(own).over(order), F.when(~few, F.first(own).over(order)), *[F.when(few, F.lag(own, k).over(order)) for k in range(2, FEW)]]
    heads = dealt.where(F.col("n") > SALTED).groupBy("bucket", "salt").agg(F.min(own).alias("own")).select("bucket", "own.*")
    across = Window.partitionBy("bucket").orderBy("node")
    head_back = [F.lag(own).over(across), F.first(own).over(across)]
    pairs = dealt.select("node", "tag", F.array(*back).alias("earlier")).unionByName(heads.select("node", "tag", F.array(*head_back).alias("earlier")))
    pairs = pairs.select("node", "tag", F.explode(F.array_compact("earlier")).alias("e")).where("e.node <> node")
    if near:
        pairs = pairs.where(near(F.col("tag"), F.col("e.tag")))
    return pairs.select("node", F.col("e.node").alias("before")).distinct()


def roots(grouped: DataFrame, found: DataFrame, payloads: DataFrame, kernel: Kernel) -> DataFrame:
    """``node, root`` for nodes that are linked: by ``found`` (a, b), links among the first pairs, or in ``grouped``
    (from ``groups``) by ``kernel`` over ``payloads`` (node, payload; all nodes of groups have one)."""
    found = materialise(found, "first-links")
    first = components(found)
    if not grouped.head(1):
        return first
    more = materialise(_rest(grouped, first, payloads, kernel), "rest-links")
    return components(found.unionByName(more)) if more.head(1) else first


def _rest(grouped: DataFrame, known: DataFrame, payloads: DataFrame, kernel: Kernel) -> DataFrame:
    placed = grouped.join(known, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed, "placed", grouped.count())
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    split = parts.groupBy("bucket").agg(F.max_by("root", "k").alias("main"), F.max("k").alias("k"), F.sum("k").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    split = split.select("bucket", "main", F.ceil((F.col("n") - F.col("k")) / BLOCK).alias("strays"), F.ceil(F.col("k") / BLOCK).alias("mains"))
    within = placed.join(split, "bucket")
    own = F.when(F.col("root") == F.col("main"), F.col("strays") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("strays")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("root") == F.col("main"), F.col("strays") - 1).otherwise(F.col("strays") + F.col("mains") - 1).cast("long"))
    dealt = within.withColumn("own", own.cast("long")).select("bucket", "node", "root", "own", F.explode(others).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root").join(payloads, "node")

    def run(block: pa.Table) -> pa.Table:
        forget()
        node, part = (np.asarray(block.column(c).to_pylist(), np.int64) for c in ("node", "root"))
        payload = block.column("payload").to_pylist()
        near_to = kernel([np.asarray(p, np.int64) if isinstance(p, list) else p for p in payload])
        ends = []
        for x in range(len(node) - 1):
            others = np.flatnonzero(part[x + 1 :] != part[x]) + x + 1
            while len(others):
                some, others = others[:AT_ONCE], others[AT_ONCE:]
                for y in some[near_to(x, some)]:
                    if part[x] != part[y]:
                        part[part == part[y]] = part[x]
                        ends.append((int(node[x]), int(node[y])))
                others = others[part[others] != part[x]]
        return pa.table({"a": pa.array([a for a, _ in ends], pa.int64()), "b": pa.array([b for _, b in ends], pa.int64())})

    return dealt.select("bucket", "i", "j", "node", "root", "payload").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()

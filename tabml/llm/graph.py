"""Connected components of an edge table by contraction, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.llm.store import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); component is the smallest id reachable.

    Each round every label takes the smallest label next to it, labels are followed twice, and the edges are
    contracted to the new labels; edges inside a label go away. Paths shrink by a constant factor a round, and a hub with any
    number of edges meets others only in a minimum with partial aggregation. Tables are written between rounds.
    """
    e = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    chain = []
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        up = low.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        step = scratch.table(low.join(up, "m").select("v", F.col("mm").alias("to")))
        chain.append(step)
        x, y = step.select(F.col("v").alias("a"), F.col("to").alias("ta")), step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        nxt = e.join(x, "a").join(y, "b").where("ta <> tb")
        nxt = scratch.table(nxt.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        scratch.drop(e)
        e = nxt
        if e.isEmpty():
            break
    scratch.drop(e)
    label = chain[0].select(F.col("v").alias("id"), F.col("to").alias("component"))
    for step in chain[1:]:
        label = label.join(step, F.col("component") == F.col("v"), "left").select("id", F.coalesce("to", "component").alias("component"))
    # the smallest id of a component takes itself in every round and all others end with its label, so the label is its name
    out = scratch.table(label)
    scratch.drop(*chain)
    return out

"""Connected components of a graph given as edges, by hooking and pointer jumping over DataFrames.

Each round every root hooks to its smallest neighbour, chains of hooks are shortened by pointer jumping until they end in roots, and
the edges are rewritten to roots; edges within a component vanish. Both the edges and the maps shrink from round to round, every
table is written to the shared folder, and the driver sees row counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stash


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null; direction, loops and repeats don't matter). Returns node, root: root is the smallest node reachable;
    nodes that no edge to another node names are absent."""
    cur = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    labels = None
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stash(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("h")).select("u", F.least("u", "h").alias("h")), "cc-hook")
        while True:
            up = hook.select(F.col("u").alias("_u"), F.col("h").alias("_h"))
            new = stash(hook.join(up, F.col("h") == F.col("_u")).select("u", F.col("_h").alias("h"), (F.col("_h") != F.col("h")).alias("moved")), "cc-jump")
            hook, moved = new.select("u", "h"), not new.where("moved").isEmpty()
            if not moved:
                break
        left = hook.select(F.col("u").alias("_a"), F.col("h").alias("_ra"))
        right = hook.select(F.col("u").alias("_b"), F.col("h").alias("_rb"))
        rewritten = cur.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
        cur = stash(rewritten.select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).where("a < b").distinct(), "cc-edges")
        if labels is None:
            labels = hook.select(F.col("u").alias("node"), F.col("h").alias("root"))
        else:
            labels = stash(labels.join(hook, F.col("root") == F.col("u"), "left").select("node", F.coalesce("h", "root").alias("root")), "cc-labels")
    if labels is None:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels

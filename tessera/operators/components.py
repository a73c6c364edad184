"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join on the edge table; the number of rounds grows with the
logarithm of the longest chain.  A hub's edges are never gathered in one task or row, and no
adjacency list, link or component on the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import join_facts
from tessera.session import cut_lineage, stored


def _least_below(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node that has one below it, of edges ``low`` < ``high``."""
    return edges.groupBy(F.col("high").alias("low")).agg(F.min("low").alias("least"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, most_rounds: int = 50) -> DataFrame:
    """Map every node that has an edge to another node to the least node of its component.

    ``edges`` may hold repeats, self-loops and nulls; those add nothing.  Returns ``node`` and
    ``component``, one row per node, isolated nodes left out; no edges give no rows.  Nodes may be
    of any orderable type.
    """
    u, v = F.col(src), F.col(dst)
    e = edges.where(u != v).select(F.least(u, v).alias("low"), F.greatest(u, v).alias("high")).distinct()
    e = cut_lineage(e)
    sum_of = F.coalesce(F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    before = None
    for _ in range(most_rounds):
        # Large star: neighbours above a node move to the least node around it.  A node without a
        # neighbour below is that itself, so only edges of other nodes change.
        large = join_facts(e, _least_below(e).hint("merge"), "low", "left").select(F.coalesce("least", "low").alias("low"), "high").distinct()
        # Small star: a node and its neighbours below move to the least of those.
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = join_facts(large, least.hint("merge"), "high").select(F.explode(F.array(F.struct(F.col("least").alias("low"), "high"), F.struct(F.col("least").alias("low"), F.col("low").alias("high")))).alias("e")).select("e.*")
        e = cut_lineage(small.where("low <> high").distinct())
        now = e.agg(F.count("*").alias("n"), sum_of.alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("low").alias("high"), "low").distinct()
    return e.select("high", "low").unionByName(roots).select(F.col("high").alias("node"), F.col("low").alias("component"))


def components_by_runs(edges: DataFrame, src: str = "src", dst: str = "dst", *, run: int = 1 << 16) -> DataFrame:
    """Like ``connected_components``, for whole numbers as nodes, where most edges join near ones.

    The edges of a run of ``run`` values of ``src`` are united in one task, which remembers the nodes of one
    run; the rounds see only roots of runs that share a node.
    """
    nodes = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b").withColumn("run", F.floor(F.col("a") / run))

    def unite(batches):
        now, root = None, {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def settled():
            return pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["node", "root"])

        for batch in batches:
            for r, a, b in zip(*(batch.column(c).to_pylist() for c in ("run", "a", "b")), strict=True):
                if r != now:
                    if root:
                        yield settled()
                    now, root = r, {}
                root.setdefault(a, a)
                root.setdefault(b, b)
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        if root:
            yield settled()

    # By the hash, as the edges may come dealt by a column that adaptive execution still splits.
    forest = stored(nodes.repartition(F.xxhash64("run")).sortWithinPartitions("run").mapInArrow(unite, "node long, root long"))
    least = stored(forest.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    shared = least.where("least < most").select("node", "least")
    joined = connected_components(join_facts(forest, shared.hint("merge"), "node"), "root", "least")
    found = join_facts(least, joined.select(F.col("node").alias("least"), "component").hint("merge"), "least", "left")
    return found.select("node", F.coalesce("component", "least").alias("component"))

"""Typed nodes and edges, evidence rows, review queues and audits of a work graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(*parts: DataFrame, key: str = "node_id", order: str = "seq") -> DataFrame:
    """Union of node tables, the first of each id by ``order``."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    row = F.struct(*[c for c in union.columns if c != key])
    return union.groupBy(key).agg(F.min_by(row, order).alias("r")).select(key, "r.*")


def short_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """prefix- and the first hex digits of the SHA-1 of the parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, digits))


def evidence(rows: DataFrame, entity: str, kinds: dict[str, Column], level: str = "node") -> DataFrame:
    """One row for each filled piece of evidence of an entity, with a content id; repeats go."""
    items = F.array_compact(F.array(*[F.when(v.isNotNull() & (F.trim(v.cast("string")) != ""), F.struct(F.lit(k).alias("kind"), F.trim(v.cast("string")).alias("value"))) for k, v in kinds.items()]))
    each = rows.select(F.col(entity).cast("string").alias("entity"), F.explode(items).alias("e")).select("entity", "e.kind", "e.value", F.lit(level).alias("level"))
    return each.distinct().withColumn("evidence_id", short_id("ev", F.col("entity"), F.col("kind"), F.col("value")))


def lacking(nodes_of: DataFrame, edges: DataFrame, kind: str, node: str = "node_id", source: str = "source_id", edge_kind: str = "edge_type") -> DataFrame:
    """Nodes without an outgoing edge of a kind."""
    have = edges.where(F.col(edge_kind) == kind).select(F.col(source).alias("have"))
    return nodes_of.join(have, F.col(node) == F.col("have"), "left_anti")


def audit(nodes_of: DataFrame, edges: DataFrame, node: str = "node_id", source: str = "source_id", target: str = "target_id", edge_kind: str = "edge_type") -> DataFrame:
    """(problem, n): self links, endpoints that are no node, repeated edges."""
    known = nodes_of.select(F.col(node).alias("known")).distinct()
    selfs = edges.where(F.col(source) == F.col(target)).agg(F.lit("self_link").alias("problem"), F.count("*").alias("n"))
    ends = edges.select(F.explode(F.array(source, target)).alias("end"))
    loose = ends.join(known, F.col("end") == F.col("known"), "left_anti").agg(F.lit("orphan_endpoint").alias("problem"), F.count("*").alias("n"))
    repeats = edges.groupBy(source, target, edge_kind).agg(F.count("*").alias("c")).agg(F.lit("duplicate_edge").alias("problem"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    return selfs.unionByName(loose).unionByName(repeats)


def grouped_candidates(pairs: DataFrame, group: str, member: str, score: str) -> DataFrame:
    """Groups with their best score and members in order."""
    return pairs.groupBy(group).agg(F.max(score).alias("best"), F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members"), F.count_distinct(member).alias("n"))


def band(score: Column, limits: dict[str, float]) -> Column:
    """The first band, highest first, whose limit the score reaches."""
    out = F.lit("none")
    for name, limit in sorted(limits.items(), key=lambda x: x[1]):
        out = F.when(score >= limit, name).otherwise(out)
    return out

"""Maintenance: orphan nodes, audiences, demotion, merging of colliding labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import graph


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, id of nodes that no edge of their scope touches."""
    ends = graph.endpoints(edges).distinct().withColumnRenamed("node_id", "id")
    return nodes.select("scope", "id").join(ends, ["scope", "id"], "left_anti")


def classify_audience(edges: DataFrame, identities: DataFrame) -> DataFrame:
    """id, new_audience, outcome of the unclassified edges that are not rejected.

    Without a session an edge is the tenant's; else ``identities`` (source_session, identity) decides; without an answer it stays.
    """
    open_ = graph.normal_edges(edges).where((F.col("audience") == "") & (F.col("status") != "rejected"))
    met = open_.join(identities.select("source_session", "identity"), "source_session", "left")
    blank = F.trim(F.coalesce("source_session", F.lit(""))) == ""
    known = F.trim(F.coalesce("identity", F.lit(""))) != ""
    outcome = F.when(blank, "tenant").when(known, "identity").otherwise("unresolved")
    new = F.when(blank, "tenant").when(known, F.concat(F.lit("identity:"), F.trim("identity"))).otherwise("")
    return met.select("id", new.alias("new_audience"), outcome.alias("outcome"))


def demote(edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """id of accepted edges of these relations that came out of a session: to be proposals again."""
    rows = graph.normal_edges(edges)
    return rows.where((F.col("status") == "accepted") & F.col("relation").isin(*relations) & (F.trim(F.coalesce("source_session", F.lit(""))) != "")).select("id")


def fold_collisions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, node_type, label_key, id, degree, survivor_id: nodes of one folded label; most edge ends survive, equal ones by least id."""
    ends = graph.endpoints(edges).groupBy("scope", "node_id").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("node_id", "id")
    key = ["scope", "node_type", "label_key"]
    rows = nodes.where(F.col("label").isNotNull()).select("scope", "id", graph.node_type(F.col("node_type")).alias("node_type"), text.fold_label(F.trim("label")).alias("label_key"))
    rows = rows.join(ends, ["scope", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    groups = rows.groupBy(*key).agg(F.max(F.struct("degree", (-F.col("id")).alias("m"))).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups.select(*key, (-F.col("s.m")).alias("survivor_id")), key)


def merge_collisions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after the merge: id, scope, source_id, target_id, relation; losers: scope, id, survivor_id).

    Ends of losers move to their survivor; edges within a pair go; of edges that become equal the least id stays.
    """
    losers = fold_collisions(nodes, edges).where("id <> survivor_id").select("scope", "id", "survivor_id")
    out = edges.select("id", "scope", "source_id", "target_id", "relation")
    for end in ("source_id", "target_id"):
        m = losers.select("scope", F.col("id").alias(end), F.col("survivor_id").alias("__to"))
        out = out.join(m, ["scope", end], "left").withColumn(f"__{end}", F.coalesce("__to", end)).withColumn(f"__m{end}", F.col("__to").isNotNull()).drop("__to")
    touched = F.col("__msource_id") | F.col("__mtarget_id")
    out = out.where(~(touched & (F.col("__source_id") == F.col("__target_id"))))
    w = Window.partitionBy("scope", "__source_id", "__target_id", "relation")
    # only keys that a moved edge enters lose repeats
    out = out.withColumn("__t", F.max(touched).over(w)).withColumn("__n", F.row_number().over(w.orderBy("id")))
    kept = out.where(~F.col("__t") | (F.col("__n") == 1))
    return kept.select("id", "scope", F.col("__source_id").alias("source_id"), F.col("__target_id").alias("target_id"), "relation"), losers

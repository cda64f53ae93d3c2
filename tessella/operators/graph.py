"""Knowledge graph: merging writes, audience-filtered reads, walks over many starts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scoring, text
from tessella.operators.guards import EDGE_STATUSES, NODE_TYPES, TENANT, need_limit, need_status
from tessella.plans.durable import cut
from tessella.plans.sized import small_or_not

STAFF = "__staff__"


def node_type(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin(*NODE_TYPES), t).otherwise("CONCEPT")


def edge_status(c: Column) -> Column:
    """A blank status is accepted, an unknown one only proposed."""
    t = F.lower(F.trim(c))
    return F.when(c.isNull() | (t == ""), "accepted").when(t.isin("accepted", "proposed", "rejected"), t).otherwise("proposed")


def audience_of(c: Column) -> Column:
    """tenant, ``identity:<id>``, or unclassified (empty) for anything else."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when((t == TENANT) | t.rlike(r"^identity:\s*\S"), t).otherwise("")


def can_read(reader: str, row: Column) -> Column:
    """Staff reads everything, everyone what is the tenant's, an identity what is its own; unclassified rows are for staff only."""
    a = audience_of(row)
    if reader == STAFF:
        return F.lit(True)
    own = F.lit(reader)
    return (a == TENANT) | ((a != "") & (a == own))


def normal_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("status", edge_status(F.col("status"))).withColumn("audience", audience_of(F.col("audience")))


def visible_edges(edges: DataFrame, reader: str, accepted_only: bool = True) -> DataFrame:
    rows = normal_edges(edges).where(can_read(reader, F.col("audience")))
    return rows.where(F.col("status") == "accepted") if accepted_only else rows


def endpoints(edges: DataFrame) -> DataFrame:
    """scope, node_id of both ends of every edge, repeated for repeated edges."""
    return edges.select("scope", F.explode(F.array("source_id", "target_id")).alias("node_id")).where(F.col("node_id").isNotNull())


def visible_nodes(nodes: DataFrame, edges: DataFrame, reader: str) -> DataFrame:
    """Nodes that a visible edge of their scope touches; staff also sees those without any."""
    if reader == STAFF:
        return nodes
    ends = endpoints(visible_edges(edges, reader, accepted_only=False)).distinct()
    return nodes.join(ends.withColumnRenamed("node_id", "id"), ["scope", "id"], "left_semi")


def upsert_nodes(batch: DataFrame) -> DataFrame:
    """One node per scope, folded label and type after writing in order of id.

    The first accented spelling stays, else the first; attributes merge key by key, later ones win; the last vector stays.
    """
    rows = batch.where(F.col("label").isNotNull() & (F.trim("label") != "")).withColumn("node_type", node_type(F.col("node_type"))).withColumn("label_key", text.fold_label(text.squeezed(F.col("label"))))
    accented = F.when(text.has_diacritics(F.col("label")), F.col("id"))
    merged = rows.groupBy("scope", "label_key", "node_type").agg(
        F.min("id").alias("id"),
        F.coalesce(F.min_by("label", accented), F.min_by("label", "id")).alias("label"),
        F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("id"))).alias("embedding"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.count(F.lit(1)).alias("n_writes"),
    )
    # attributes merge one key at a time: the last write of each, combined before the shuffle
    key = ["scope", "label_key", "node_type"]
    entry = rows.select(*key, "id", F.explode("attributes").alias("k", "v")).groupBy(*key, "k").agg(F.max_by("v", "id").alias("v"))
    maps = entry.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    known = maps.select(*(F.col(c).alias(f"__{c}") for c in key), "attributes")
    same = merged["scope"].eqNullSafe(known["__scope"]) & (merged["label_key"] == known["__label_key"]) & (merged["node_type"] == known["__node_type"])
    none = F.create_map().cast("map<string,string>")
    return merged.join(known, same, "left").withColumn("attributes", F.coalesce("attributes", none)).drop(*(f"__{c}" for c in key))


def upsert_edges(batch: DataFrame) -> DataFrame:
    """One edge per scope, ends and relation after writing in order of id: an ordered fold per key.

    A proposal cannot change an accepted edge at all; accepted and rejected stick; an audience is only filled in, never
    widened; the confidence is the greatest.

    No key's writes are collected: the first write that accepts or rejects decides the status for good, so everything
    follows from least ids, which are combined before the shuffle.
    """
    rows = normal_edges(batch).where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    key = ["scope", "source_id", "target_id", "relation"]
    settles = F.when(F.col("status").isin("accepted", "rejected"), F.struct("id", "status"))
    first = rows.groupBy(*key).agg(F.min(settles).alias("__first"), F.max(F.struct("id", "status")).alias("__last"), F.min("id").alias("__id"))
    known = first.select(*(F.col(c).alias(f"__{c}") for c in key), "__first", "__last", "__id")
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(known[f"__{c}"]) for c in key))
    # a proposal after the acceptance changes nothing
    ignored = F.coalesce((F.col("__first.status") == "accepted") & (F.col("status") == "proposed") & (F.col("id") > F.col("__first.id")), F.lit(False))
    met = rows.join(known, same)
    counts = F.when(~ignored, F.lit(1))
    given = F.when(~ignored & (F.col("audience") != ""), F.struct("id", "audience"))
    return (
        met.groupBy(*key)
        .agg(
            F.min("__id").alias("id"),
            F.first(F.coalesce("__first.status", "__last.status")).alias("status"),
            F.coalesce(F.min(given)["audience"], F.lit("")).alias("audience"),
            F.round(F.max(F.when(~ignored, F.col("confidence").cast("double"))), 6).alias("confidence"),
            F.count(counts).cast("int").alias("n_applied"),
        )
        .select("id", *key, "status", "audience", "confidence", "n_applied")
    )


COORDINATE = ["scope", "source", "target", "relation"]


def _curate(edges: DataFrame, nodes: DataFrame, changes: DataFrame, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, outcome per change).  ``changes``: scope, source, target (labels), relation, value."""
    names = nodes.groupBy("scope", text.fold_label(F.trim("label")).alias("__l")).agg(F.collect_set("id").alias("__ids"))
    asked = changes.select(*COORDINATE, value.alias("__v")).dropDuplicates(COORDINATE)
    placed = asked
    for end in ("source", "target"):
        own = names.select("scope", F.col("__l").alias(f"__{end}"), F.explode("__ids").alias(f"{end}_id"))
        placed = placed.withColumn(f"__{end}", text.fold_label(F.trim(end))).join(own, ["scope", f"__{end}"], "left")
    at = placed.select("scope", "source_id", "target_id", "relation", *(F.col(c).alias(f"__c_{c}") for c in ("source", "target")), "__v")
    one = at.groupBy("scope", "source_id", "target_id", "relation").agg(F.max("__v").alias("__v"), F.lit(True).alias("__hit"))
    met = edges.join(one, ["scope", "source_id", "target_id", "relation"], "left")
    new = met.withColumn(column, F.when(F.col("__hit"), F.col("__v")).otherwise(F.col(column))).select(*edges.columns)
    found = at.join(edges.select("scope", "source_id", "target_id", "relation").distinct().withColumn("__is", F.lit(True)), ["scope", "source_id", "target_id", "relation"], "left")
    said = found.groupBy("scope", F.col("__c_source").alias("source"), F.col("__c_target").alias("target"), "relation").agg(F.coalesce(F.max("__is"), F.lit(False)).alias("found"))
    return new, said


def set_status(edges: DataFrame, nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, scope, source, target, relation, found) after setting the status of edges by their coordinates.

    ``changes``: scope, source, target (labels, folded), relation (exact), value; an unknown status is refused before anything runs.
    """
    for r in changes.select("value").distinct().limit(len(EDGE_STATUSES) + 1).collect():
        need_status(r["value"])
    return _curate(edges, nodes, changes, "status", F.col("value"))


def set_audience(edges: DataFrame, nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for the audience; what is no audience leaves the edge unclassified."""
    return _curate(edges, nodes, changes, "audience", audience_of(F.col("value")))


def repeated_references(nodes: DataFrame) -> DataFrame:
    """scope, reference, n_nodes: labels that name several nodes of a scope, so that a write by label would be ambiguous."""
    rows = nodes.select("scope", text.fold_label(F.trim("label")).alias("reference"), "id").where(F.col("reference") != "")
    return rows.groupBy("scope", "reference").agg(F.countDistinct("id").alias("n_nodes")).where("n_nodes > 1")


def create_missing(edges: DataFrame, nodes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(edges with source_id and target_id, nodes) of edges written by label: scope, source, target, relation.

    An end whose folded label no node of the scope has becomes a node of type CONCEPT; the least id of a label counts.
    Ids of new nodes follow the greatest there is, in order of scope and label.
    """
    known = nodes.groupBy("scope", text.fold_label(F.trim("label")).alias("__l")).agg(F.min("id").alias("__id"))
    ends = edges.select("scope", F.explode(F.array("source", "target")).alias("label")).where(F.col("label").rlike("\\S")).select("scope", text.squeezed(F.col("label")).alias("label")).withColumn("__l", text.fold_label(F.col("label")))
    new = ends.groupBy("scope", "__l").agg(F.min("label").alias("label")).join(known, ["scope", "__l"], "left_anti")
    # numbers without one task for all: new labels are few beside the nodes, and sorted by range
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    numbered = cut(new.orderBy("scope", "__l").withColumn("__n", F.monotonically_increasing_id())).join(F.broadcast(top))
    made = numbered.select((F.col("__top") + F.col("__n") + 1).alias("id"), "scope", "label", F.lit("CONCEPT").alias("node_type"), "__l")
    every = known.unionByName(made.select("scope", "__l", F.col("id").alias("__id")))
    out = edges
    for end in ("source", "target"):
        out = out.withColumn("__l", text.fold_label(text.squeezed(F.col(end)))).join(every.withColumnRenamed("__id", f"{end}_id"), ["scope", "__l"]).drop("__l")
    return out, nodes.unionByName(made.drop("__l").withColumn("created_at", now), allowMissingColumns=True)


def listed(nodes: DataFrame, edges: DataFrame, reader: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """scope, id, place: the first visible nodes of each scope by id, of one type if given."""
    rows = visible_nodes(nodes, edges, reader)
    if kind is not None:
        rows = rows.where(node_type(F.col("node_type")) == kind)
    w = Window.partitionBy("scope").orderBy("id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit)).select("scope", "id", "place")


def counted(nodes: DataFrame, edges: DataFrame, reader: str, label: str | None = None, kind: str | None = None) -> DataFrame:
    """scope, n_nodes: visible nodes, of one type or one folded label if given."""
    rows = visible_nodes(nodes, edges, reader)
    if kind is not None:
        rows = rows.where(node_type(F.col("node_type")) == kind)
    if label is not None:
        rows = rows.where(text.fold_label(F.trim("label")) == text.fold_label(F.trim(F.lit(label))))
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n_nodes"))


def scanned(nodes: DataFrame, edges: DataFrame, reader: str, after_id: int = 0, limit: int = 1000) -> DataFrame:
    """id, scope: the next page of visible nodes by id."""
    return visible_nodes(nodes, edges, reader).where(F.col("id") > after_id).orderBy("id").limit(need_limit(limit)).select("id", "scope")


def with_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that any edge of their scope touches, whatever its status or audience."""
    return nodes.join(endpoints(edges).distinct().withColumnRenamed("node_id", "id"), ["scope", "id"], "left_semi")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scope, node_id of ends without a node in their scope: those a label-based write would create as CONCEPT."""
    known = nodes.select("scope", F.col("id").alias("node_id"))
    return endpoints(edges).distinct().join(known, ["scope", "node_id"], "left_anti")


def delete_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of ``gone`` (scope, id) and the edges at them."""
    keys = gone.select("scope", "id").distinct()
    left = edges
    for end in ("source_id", "target_id"):
        left = left.join(keys.withColumnRenamed("id", end), ["scope", end], "left_anti")
    return nodes.join(keys, ["scope", "id"], "left_anti"), left


def delete_by_session(edges: DataFrame, scope: str, session: str) -> DataFrame:
    if not session.strip():
        raise ValueError("session must not be blank")
    return edges.where(~F.coalesce((F.col("scope") == scope) & (F.col("source_session") == session), F.lit(False)))


def find(nodes: DataFrame, edges: DataFrame, labels: DataFrame, reader: str) -> DataFrame:
    """Visible nodes by folded label; ``labels``: scope, wanted."""
    keys = labels.select("scope", text.fold_label(F.trim("wanted")).alias("label_key")).distinct()
    rows = visible_nodes(nodes, edges, reader).withColumn("label_key", text.fold_label(F.trim("label")))
    return rows.join(keys, ["scope", "label_key"], "left_semi")


def nearest(nodes: DataFrame, edges: DataFrame, queries: DataFrame, reader: str, limit: int = 5, related_only: bool = False, width: int = 64) -> DataFrame:
    """scope, query_id, id, similarity, place: exact nearest visible nodes; ``queries``: scope, query_id, query_vector."""
    rows = visible_nodes(nodes, edges, reader).where(scoring.usable_vector(F.col("embedding"), width))
    if related_only:
        ends = endpoints(visible_edges(edges, reader)).distinct()
        rows = rows.join(ends.withColumnRenamed("node_id", "id"), ["scope", "id"], "left_semi")
    met = rows.select("scope", "id", "embedding").join(small_or_not(queries), "scope").withColumn("similarity", F.round(scoring.cosine(F.col("embedding"), F.col("query_vector")), 6))
    w = Window.partitionBy("scope", "query_id").orderBy(F.col("similarity").desc(), "id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit)).select("scope", "query_id", "id", "similarity", "place")


def walk(edges: DataFrame, starts: DataFrame, reader: str, max_depth: int = 2) -> DataFrame:
    """scope, start_id, edge_id, depth: every accepted visible edge within ``max_depth`` hops, once, at its least depth.

    Breadth first for all starts at once (``starts``: scope, start_id): each round joins the frontier with both ends of
    the edges and drops nodes met before.  An edge is there iff an end is nearer than ``max_depth``; edges are collected
    only once, at the end, against the final distances.
    """
    live = visible_edges(edges, reader).where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select("scope", F.col("id").alias("edge_id"), "source_id", "target_id")
    ends = live.select("scope", "edge_id", F.col("source_id").alias("node_id"), F.col("target_id").alias("other")).unionByName(live.select("scope", "edge_id", F.col("target_id").alias("node_id"), F.col("source_id").alias("other")))
    reached = starts.select("scope", "start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("dist"))
    frontier = reached
    for depth in range(1, max_depth):
        step = frontier.join(ends, ["scope", "node_id"]).select("scope", "start_id", F.col("other").alias("node_id")).distinct()
        frontier = step.join(reached, ["scope", "start_id", "node_id"], "left_anti").withColumn("dist", F.lit(depth))
        reached = reached.unionByName(frontier)
    return reached.join(ends, ["scope", "node_id"]).groupBy("scope", "start_id", "edge_id").agg((F.min("dist") + 1).alias("depth"))


def neighbours(edges: DataFrame, reader: str) -> DataFrame:
    """scope, node_id, other_id: the different other ends of accepted visible edges."""
    live = visible_edges(edges, reader)
    both = live.select("scope", F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id")).unionByName(live.select("scope", F.col("target_id").alias("node_id"), F.col("source_id").alias("other_id")))
    return both.where("node_id <> other_id").distinct()


def type_histogram(nodes: DataFrame, edges: DataFrame, reader: str) -> DataFrame:
    return visible_nodes(nodes, edges, reader).groupBy("scope", node_type(F.col("node_type")).alias("node_type")).agg(F.count(F.lit(1)).alias("n_nodes"))


def top_degrees(nodes: DataFrame, edges: DataFrame, reader: str, top: int = 5) -> DataFrame:
    """scope, id, degree, place: nodes of most accepted visible edge ends, zero included, equal ones by id."""
    ends = endpoints(visible_edges(edges, reader)).groupBy("scope", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    rows = visible_nodes(nodes, edges, reader).select("scope", "id").join(ends.withColumnRenamed("node_id", "id"), ["scope", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("scope").orderBy(F.col("degree").desc(), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(top))


def pending(edges: DataFrame, nodes: DataFrame, reader: str, limit: int = 100) -> DataFrame:
    """The oldest proposals of each scope whose both ends exist, with their labels."""
    rows = visible_edges(edges, reader, accepted_only=False).where(F.col("status") == "proposed")
    names = nodes.select("scope", "id", "label")
    for end in ("source", "target"):
        rows = rows.join(names.select("scope", F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label")), ["scope", f"{end}_id"])
    w = Window.partitionBy("scope").orderBy("created_at", "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit)).select("scope", "id", "source_label", "relation", "target_label", "place")


MAX_CHARS, MAX_DETAIL = 2_000, 120


def context_lines(walked: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scope, start_id, edge_id, depth, line: one line per walked edge, its attributes in brackets, cut at a bound."""
    names = nodes.select("scope", "id", "label")
    rows = walked.join(edges.select("scope", F.col("id").alias("edge_id"), "source_id", "target_id", "relation", "attributes"), ["scope", "edge_id"])
    for end in ("source", "target"):
        rows = rows.join(names.select("scope", F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label")), ["scope", f"{end}_id"])
    pairs = F.filter(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.struct(e["key"].alias("k"), text.squeezed(e["value"]).alias("v"))), lambda e: e["v"] != "")
    detail = F.array_join(F.transform(pairs, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), "; ")
    detail = F.when(F.length(detail) > MAX_DETAIL, F.concat(F.rtrim(F.left(detail, F.lit(MAX_DETAIL - 1))), F.lit("…"))).otherwise(detail)
    tail = F.when(F.coalesce(F.length(detail), F.lit(0)) > 0, F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise("")
    return rows.select("scope", "start_id", "edge_id", "depth", F.concat(F.lit("- "), "source_label", F.lit(" --["), "relation", F.lit("]--> "), "target_label", tail).alias("line"))


def context(lines: DataFrame, header: str = "[Knowledge Graph]", max_chars: int = MAX_CHARS) -> DataFrame:
    """scope, start_id, context: lines by depth and edge id until the first that does not fit."""
    w = Window.partitionBy("scope", "start_id").orderBy("depth", "edge_id")
    used = F.sum(F.length("line") + 1).over(w) + len(header)
    fits = lines.withColumn("__used", used).where(F.col("__used") <= max_chars)
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "edge_id", "line"))), lambda x: x["line"]), "\n")
    return fits.groupBy("scope", "start_id").agg(F.concat(F.lit(header + "\n"), text_).alias("context"))

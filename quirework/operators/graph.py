"""The concept graph as two tables: concepts (id, description, is_main, source_locators) and relations (source, type, target,
source_locators). Every operator is a join or an aggregate over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.relations import normalize_relation
from quirework.functions.text import mermaid_escape, strip

CONTEXT = ["source", "source_desc", "relation", "target", "target_desc"]


def _in_order(value: str = "locator") -> Column:
    """Values in order of first appearance, of groups that may be large: each value is kept once before sorting."""
    return F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value])


def merge_concepts(sightings: DataFrame) -> DataFrame:
    """Concepts of sightings (ord, id, description, is_main, locator): the last description that isn't empty, main if ever
    main, locators in order of first appearance. Stored concepts take part as sightings with lower ord."""
    s = sightings.withColumn("id", strip(F.col("id"))).filter("id <> ''").withColumn("description", F.coalesce("description", F.lit("")))
    facts = s.groupBy("id").agg(F.coalesce(F.max_by(F.nullif("description", F.lit("")), F.when(F.col("description") != "", F.col("ord"))), F.lit("")).alias("description"), F.max(F.coalesce("is_main", F.lit(False))).alias("is_main"))
    where = s.filter("locator is not null").groupBy("id", "locator").agg(F.min("ord").alias("first")).groupBy("id").agg(_in_order().alias("source_locators"))
    return facts.join(where, "id", "left").withColumn("source_locators", F.coalesce("source_locators", F.array().cast("array<string>")))


def merge_relations(sightings: DataFrame) -> DataFrame:
    """Relations of sightings (ord, source, type, target, locator): one for each triple; blank ends and bad types are dropped."""
    s = sightings.withColumn("source", strip(F.col("source"))).withColumn("target", strip(F.col("target"))).withColumn("type", normalize_relation(F.col("type"))).filter("source <> '' and target <> '' and type <> ''")
    once = s.groupBy("source", "type", "target", "locator").agg(F.min("ord").alias("first"))
    return once.groupBy("source", "type", "target").agg(_in_order().alias("source_locators"))


def remove_locator(concepts: DataFrame, relations: DataFrame, locator: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a locator; what had no other goes, concepts with all their relations. What never had it stays."""
    def less(df: DataFrame) -> DataFrame:
        had = F.coalesce(F.array_contains("source_locators", locator), F.lit(False))
        return df.withColumn("had", had).withColumn("source_locators", F.when(F.col("had"), F.array_remove("source_locators", locator)).otherwise(F.col("source_locators")))

    c, r = less(concepts), less(relations).filter("not had or size(source_locators) > 0").drop("had")
    gone = c.filter("had and size(source_locators) = 0").select("id")
    kept = c.filter("not had or size(source_locators) > 0").drop("had")
    for end in ("source", "target"):
        r = r.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return kept, r.select("source", "type", "target", "source_locators")


def from_source(locators: Column, source: str) -> Column:
    """Whether any locator is of the source; with no source, always."""
    return F.lit(True) if not source else F.coalesce(F.exists(locators, lambda x: F.startswith(x, F.lit(source + "::"))), F.lit(False))


def _described(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    out = relations.select("source", F.col("type").alias("relation"), "target").distinct()
    for end in ("source", "target"):
        out = out.join(concepts.select(F.col("id").alias(end), F.coalesce("description", F.lit("")).alias(f"{end}_desc")), end)
    return out.select(*CONTEXT)


def graph_context(concepts: DataFrame, relations: DataFrame, names: DataFrame, mode: str = "search", source: str = "") -> DataFrame:
    """Relations around the names (name): ``semi_search`` those into them, ``one_hop`` those at them, ``search`` those at
    them or at any neighbour. Only the relations given are filtered by source, not those walked over. In order of source,
    relation and target."""
    n = names.select(F.col("name").alias("n")).filter("n <> ''").distinct()
    if mode == "semi_search":
        picked = relations.join(n, relations["target"] == n["n"], "left_semi")
    else:
        if mode != "one_hop":
            n = n.join(concepts.select(F.col("id").alias("n")), "n", "left_semi")
            ends = relations.select("source", "target")
            pairs = ends.unionByName(ends.select(F.col("target").alias("source"), F.col("source").alias("target")))
            n = n.union(pairs.join(n, pairs["source"] == n["n"], "left_semi").select("target")).distinct()
        out, into = (relations.join(n, relations[e] == n["n"], "left_semi") for e in ("source", "target"))
        picked = out.unionByName(into).dropDuplicates(["source", "type", "target"])
    return _described(picked.filter(from_source(F.col("source_locators"), source)), concepts).orderBy("source", "relation", "target")


def concept_subgraph(concepts: DataFrame, relations: DataFrame, target: str, max_depth: int = 2) -> DataFrame:
    """One row (prerequisites, leads_to, related_concepts), sorted: up to 1 to 5 steps over PREREQUISITE_OF, and one over
    RELATES_TO either way. An unknown target has empty lists."""
    depth = max(1, min(int(max_depth), 5))
    there = concepts.filter(F.col("id") == target).select(F.col("id").alias("at"))
    steps = relations.filter("type = 'PREREQUISITE_OF'").select("source", "target")

    def walk(start: str, end: str) -> DataFrame:
        level, seen = there, None
        for _ in range(depth):
            level = steps.join(level, steps[start] == level["at"]).select(F.col(end).alias("at")).distinct()
            seen = level if seen is None else seen.union(level).distinct()
        return seen

    rel = relations.filter("type = 'RELATES_TO'")
    near = rel.join(there, rel["source"] == there["at"]).select(F.col("target").alias("at")).union(rel.join(there, rel["target"] == there["at"]).select(F.col("source").alias("at")))
    parts = [df.agg(F.array_sort(F.collect_set("at")).alias(name)) for df, name in ((walk("target", "source"), "prerequisites"), (walk("source", "target"), "leads_to"), (near, "related_concepts"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def visual_graph(concepts: DataFrame, relations: DataFrame, locator: str | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, description, source_locators, is_main) and edges (source, label, target): all, those of a source, or those
    with a locator. Relations that never had locators go by those of both their ends."""
    none = F.array().cast("array<string>")
    if source:
        nodes, edges = (df.filter(from_source(F.col("source_locators"), source)) for df in (concepts, relations))
    elif locator is None:
        nodes, edges = concepts, relations
    else:
        has = F.coalesce(F.array_contains("source_locators", locator), F.lit(False))
        nodes = concepts.filter(has)
        loose = relations.filter("source_locators is null")
        for end in ("source", "target"):
            loose = loose.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        edges = relations.filter(has).unionByName(loose)
    nodes = nodes.select("id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("source_locators", none).alias("source_locators"), F.coalesce("is_main", F.lit(False)).alias("is_main"))
    return nodes.orderBy("id"), edges.select("source", F.col("type").alias("label"), "target").orderBy("source", "target", "label")


def concept_names(concepts: DataFrame) -> DataFrame:
    return concepts.select("id").orderBy("id")


def relation_lines(edges: DataFrame) -> DataFrame:
    """(line): source —RELATION→ target."""
    return edges.select(F.concat("source", F.lit(" —"), F.coalesce(F.nullif("relation", F.lit("")), "label"), F.lit("→ "), "target").alias("line"))


def mermaid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (diagram) of edges (ord, source, label, target) and nodes (ord, id): for display, so of a size to be looked at."""
    edges = edges.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("target", F.coalesce("target", F.lit(""))).filter("source <> '' or target <> ''")
    ends = edges.select("ord", F.posexplode(F.array("source", "target")).alias("k", "name")).select("name", F.struct(F.lit(0).alias("lone"), F.col("ord").cast("long").alias("ord"), F.col("k").cast("long").alias("k")).alias("at"))
    lone = nodes.filter("id <> ''").select(F.col("id").alias("name"), F.struct(F.lit(1).alias("lone"), F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("k")).alias("at"))
    first = ends.union(lone).groupBy("name").agg(F.min("at").alias("at"))
    first = first.withColumn("n", F.row_number().over(Window.orderBy("at")) - 1)
    first = first.withColumn("box", F.concat(F.lit("n"), F.col("n").cast("string"), F.lit('["'), mermaid_escape(F.col("name")), F.lit('"]')))
    a, b = (first.select(F.col("name").alias(e), F.col("box").alias(f"{e}_box")) for e in ("source", "target"))
    drawn = edges.join(a, "source").join(b, "target").select(F.struct(F.lit(0).alias("lone"), F.col("ord").cast("long").alias("ord")).alias("at"), F.concat(F.lit("  "), "source_box", F.lit(" -->|"), mermaid_escape(F.coalesce("label", F.lit(""))), F.lit("| "), "target_box").alias("line"))
    alone = first.filter("at.lone = 1").select(F.struct(F.lit(1).alias("lone"), F.col("at.ord").alias("ord")).alias("at"), F.concat(F.lit("  "), "box").alias("line"))
    body = drawn.union(alone).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select(F.concat(F.lit("graph LR"), F.when(F.col("body") != "", F.concat(F.lit("\n"), "body")).otherwise("")).alias("diagram"))


def unique_edges(rows: DataFrame) -> DataFrame:
    """(source, relation, target) once each, without blanks; relation, or else label, or else type."""
    rel = F.coalesce(*[F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("relation", "label", "type") if c in rows.columns])
    return rows.select(strip(F.col("source")).alias("source"), rel.alias("relation"), strip(F.col("target")).alias("target")).filter("source <> '' and target <> '' and relation is not null").distinct()


def source_counts(concepts: DataFrame, relations: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(source, nodes, relationships) of each source."""
    def count(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.explode(F.array_distinct(F.transform("source_locators", lambda x: F.substring_index(x, "::", 1)))).alias("source"))
        return each.groupBy("source").agg(F.count("*").alias(name))

    base = relations.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    out = base.join(count(concepts, "nodes"), "source", "left").join(count(relations, "relationships"), "source", "left")
    return out.na.fill(0, ["nodes", "relationships"])

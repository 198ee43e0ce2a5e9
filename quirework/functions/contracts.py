"""What replies of models have to look like: parsed and checked as columns, so that a reply that breaks its contract can be told
from one that keeps it, for all sections at once."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.providers import loose_json
from quirework.functions.relations import normalize_relation
from quirework.functions.text import normalized_phrase, strip

EDGE = "struct<source:string,relation:string,target:string,evidence_id:string>"
STEP = "struct<seq_id:int,title:string,content_focus:string,concepts:array<string>>"
PLAN = f"struct<main_entities:array<string>,learning_roadmap:array<{STEP}>>"
GRAPH = f"struct<nodes:array<struct<name:string,description:string>>,edges:array<{EDGE}>>"
AOT = f"struct<main_entities:array<string>,learning_roadmap:array<{STEP}>,knowledge_graph:{GRAPH}>"
#: Candidates that a verifier sees, at most; what stands for no spans.
MOST_VERIFIED, NO_SPANS = 12, "(no evidence spans)"
WHOLE_PART = r"(?:consists of|is composed of|is made up of|is (?:an? |the )?(?:component|element|layer|module|part) (?:in|of|within)|forms? (?:an? )?part of)\b"


def has_whole_part_cue(text: Column) -> Column:
    """Whether the text says in so many words that something is part of something."""
    return normalized_phrase(text).rlike(WHOLE_PART)


def json_object(reply: Column) -> Column:
    """The JSON object in a reply, or null: in a fence, or from the first brace on, whatever follows it."""

    def one(text: str | None) -> str | None:
        try:
            value = loose_json(text or "")
        except ValueError:
            return None
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None

    return F.pandas_udf(lambda s: s.map(one), "string")(reply)


def parse_plan(json_text: Column) -> Column:
    """A plan; absent lists are empty, and null stands for a reply that isn't one."""
    p = F.from_json(json_text, PLAN)
    ok = json_text.isNotNull() & _lists(json_text, "main_entities", "learning_roadmap") & ~_others(json_text, ("main_entities", "learning_roadmap"))
    none = F.array().cast(f"array<{STEP}>")
    return F.when(ok, F.struct(F.coalesce(p["main_entities"], F.array().cast("array<string>")).alias("main_entities"), F.coalesce(p["learning_roadmap"], none).alias("learning_roadmap")))


def parse_graph(json_text: Column) -> Column:
    """A graph, bare or under knowledge_graph, with its well-formed edges; null stands for a reply that isn't one."""
    inner = F.coalesce(F.get_json_object(json_text, "$.knowledge_graph"), json_text)
    g = F.from_json(inner, GRAPH)
    nodes = F.coalesce(g["nodes"], F.array().cast("array<struct<name:string,description:string>>"))
    edges = valid_edges(F.coalesce(g["edges"], F.array().cast(f"array<{EDGE}>")))
    return F.when(json_text.isNotNull() & _lists(inner, "nodes", "edges"), F.struct(nodes.alias("nodes"), edges.alias("edges")))


def _lists(json_text: Column, *names: str) -> Column:
    """Whether these members, where they are there, are lists."""
    ok = F.lit(True)
    for n in names:
        v = F.get_json_object(json_text, f"$.{n}")
        ok = ok & (v.isNull() | F.startswith(v, F.lit("[")))
    return ok


def _others(json_text: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>")), F.array(*map(F.lit, names)))) > 0


def valid_edges(edges: Column) -> Column:
    """The edges with ends, an evidence id and a relation that is a name; relations in their canonical form. An edge without a
    relation has RELATES_TO."""
    named = F.transform(edges, lambda e: e.withField("relation", normalize_relation(F.coalesce(e["relation"], F.lit("RELATES_TO")))))
    return F.filter(named, lambda e: e["source"].isNotNull() & e["target"].isNotNull() & (F.coalesce(e["evidence_id"], F.lit("")) != "") & (e["relation"] != ""))


def parse_approvals(json_text: Column, candidates: Column) -> Column:
    """The indexes that a verifier approves, of at most ``MOST_VERIFIED`` candidates numbered from 0; null if it approves more,
    or gives other than indexes. Those out of range stay, for the gate to reject."""
    a = F.from_json(json_text, "struct<approvals:array<struct<index:int>>>")["approvals"]
    ok = a.isNotNull() & (F.size(a) <= MOST_VERIFIED) & ~F.exists(a, lambda x: x["index"].isNull()) & (candidates <= MOST_VERIFIED)
    return F.when(ok, F.transform(a, lambda x: x["index"]))


def rendered_spans(spans: Column) -> Column:
    """Spans (id, text) as a model sees them: [id] text, a line each."""
    lines = F.array_join(F.transform(spans, lambda s: F.concat(F.lit("["), s["id"], F.lit("] "), s["text"])), "\n")
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, lines).otherwise(NO_SPANS)


def merge_plan_and_graph(plan: Column, graph: Column) -> Column:
    """Both as one compiled section; null if either is."""
    return F.when(plan.isNotNull() & graph.isNotNull(), F.struct(plan["main_entities"].alias("main_entities"), plan["learning_roadmap"].alias("learning_roadmap"), F.struct(graph["nodes"].alias("nodes"), graph["edges"].alias("edges")).alias("knowledge_graph")))


def plan_with_local(plan: Column, edges: Column) -> Column:
    """A plan and local candidates as one compiled section: its nodes are the entities and the ends of the edges, the first of
    those with one normalised name."""
    names = F.concat(plan["main_entities"], F.flatten(F.transform(edges, lambda e: F.array(e["source"], e["target"]))))
    names = F.filter(F.transform(names, lambda n: strip(F.coalesce(n, F.lit("")))), lambda n: n != "")
    keys = F.transform(names, normalized_phrase)
    once = F.filter(names, lambda n, i: F.array_position(keys, normalized_phrase(n)) == i + 1)
    nodes = F.transform(once, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("description")))
    return F.when(plan.isNotNull(), F.struct(plan["main_entities"].alias("main_entities"), plan["learning_roadmap"].alias("learning_roadmap"), F.struct(nodes.alias("nodes"), edges.alias("edges")).alias("knowledge_graph")))


def reply_frame(call: object) -> object:
    """A pandas UDF of a provider's call that gives its reply as JSON text."""

    def one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(call(t), ensure_ascii=False))

    return F.pandas_udf(one, "string")

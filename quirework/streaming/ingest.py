"""Incremental compilation: arriving Markdown files are split, those sections that changed are compiled, tables are committed.

A stream of files with an available-now trigger: each run takes what is new and ends. Content hashes make runs idempotent.
What a run leaves can be asked: sections with anchors and vectors, roadmap steps, questions, concepts and relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirework.functions import contracts
from quirework.functions.providers import OfflineProvider, Provider, checked_questions
from quirework.functions.text import basename, content_hash, parent_id
from quirework.operators.compile import anchors, compile_relations, ground_plan
from quirework.operators.graph import merge_concepts, merge_relations
from quirework.operators.sections import split_markdown
from quirework.sources.documents import last_of_parent
from quirework.sources.records import CURRICULUM, QUESTIONS, anchor_records, delete_parents, embedded, question_records, step_records
from quirework.sources.store import SnapshotStore, not_fresh, replace_parents, stale

SECTIONS = "source string, section string, seq_id int, page_start int, page_end int, origin_source string, page_ranges array<string>, page_content string, parent_id string, content_hash string, anchor_nodes array<string>"
EDGES = "parent_id string, ord bigint, source string, relation string, target string, evidence_id string, span_text string"
CONCEPTS = "id string, description string, is_main boolean, source_locators array<string>"
RELATIONS = "source string, type string, target string, source_locators array<string>"
WANTED = 3


def identified(sections: DataFrame) -> DataFrame:
    return sections.withColumn("parent_id", parent_id(F.col("source"), F.col("section"))).withColumn("content_hash", content_hash(F.col("page_content")))


def planned(sections: DataFrame, provider: Provider) -> DataFrame:
    """A model's plan of each section, less what the section doesn't say; a reply that isn't a plan counts as an empty one."""
    reply = contracts.reply_frame(lambda text: provider.plan(text, []))
    plan = contracts.parse_plan(reply(F.col("page_content")))
    rows = sections.select("parent_id", plan.alias("plan"))
    step, edge = "array<" + contracts.STEP + ">", "array<" + contracts.EDGE + ">"
    rows = rows.select("parent_id", F.coalesce("plan.main_entities", F.array().cast("array<string>")).alias("main_entities"), F.coalesce("plan.learning_roadmap", F.array().cast(step)).alias("learning_roadmap"), F.array().cast("array<struct<name:string,description:string>>").alias("nodes"), F.array().cast(edge).alias("edges"))
    return ground_plan(rows, sections)


def asked(sections: DataFrame, provider: Provider, n: int = WANTED) -> DataFrame:
    """(parent_id, source, qa) of each section; more questions than were asked for is an error."""
    reply = contracts.reply_frame(lambda text: [{"question": q, "key_knowledge": k} for q, k in checked_questions(list(provider.questions(text, n)), n)])
    return sections.select("parent_id", "source", F.from_json(reply(F.col("page_content")), "array<struct<question:string,key_knowledge:string>>").alias("qa"))


def compiled(fresh: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, sections with anchor_nodes, roadmap steps, questions) of sections."""
    edges = compile_relations(fresh)["edges"].persist()
    plan = planned(fresh, provider)
    ends = edges.groupBy("parent_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source", "target"))), lambda e: F.array(e["source"], e["target"]))).alias("ends"))
    none = F.array().cast("array<string>")
    names = plan.join(ends, "parent_id", "left").select("parent_id", anchors(F.col("main_entities"), none, F.coalesce("ends", none)).alias("anchor_nodes"))
    steps = plan.join(fresh.select("parent_id", "source"), "parent_id").select("parent_id", "source", F.posexplode("learning_roadmap").alias("nth", "step")).select("parent_id", "source", F.col("nth").alias("seq_id"), "step.title", "step.content_focus", "step.concepts")
    return edges, fresh.drop("anchor_nodes").join(names, "parent_id", "left"), steps, asked(fresh, provider)


def nothing(sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``compiled`` gives for no section."""
    shapes = (EDGES, SECTIONS, "parent_id string, source string, seq_id int, title string, content_focus string, concepts array<string>", "parent_id string, source string, qa array<struct<question:string,key_knowledge:string>>")
    return tuple(sections.sparkSession.createDataFrame([], s) for s in shapes)


def graph_tables(edges: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The concepts and relations of edges and of sections' anchor_nodes, with the sections that they come from in order."""
    place = sections.select("parent_id", "source", "seq_id", F.concat("source", F.lit("::"), "section").alias("locator"))
    at = F.struct(F.col("p.source").alias("file"), "p.seq_id", "e.ord")
    seen = edges.alias("e").join(place.alias("p"), "parent_id").select(at.alias("ord"), "e.source", F.col("relation").alias("type"), "target", "locator")
    named = sections.alias("s").join(place.alias("p"), "parent_id").select(F.struct(F.col("p.source").alias("file"), "p.seq_id", F.lit(-1).cast("long").alias("ord")).alias("ord"), F.explode("s.anchor_nodes").alias("id"), "locator")
    ends = seen.select("ord", F.explode(F.array("source", "target")).alias("id"), "locator")
    concepts = merge_concepts(named.unionByName(ends).select("ord", "id", F.lit("").alias("description"), F.lit(False).alias("is_main"), "locator"))
    return concepts, merge_relations(seen)


def ingest(docs: DataFrame, store: SnapshotStore, provider: Provider | None = None, force: bool = False, dim: int = 64) -> int:
    """Compile the changed sections of documents (source, content), all of them with ``force``, and commit them; the number
    of sections compiled. Stored sections of these documents that are no more in them go, with all that was made of them."""
    provider = provider or OfflineProvider(dim)
    stored = store.read("sections", SECTIONS)
    now = last_of_parent(identified(split_markdown(docs))).withColumn("anchor_nodes", F.lit(None).cast("array<string>")).select(*stored.columns)
    fresh = (now if force else not_fresh(now, stored)).persist()
    gone = stale(stored, now).select("parent_id").persist()
    n = fresh.count()
    if n or gone.limit(1).count():
        # each is read by several tables, and is worth more than the room it takes; lost parts are made again
        edges, sections, steps, pairs = held = tuple(df.persist() for df in (compiled(fresh, provider) if n else nothing(fresh)))
        away = fresh.select("parent_id").union(gone)
        all_sections = replace_parents(delete_parents(stored, gone), sections.select(*stored.columns))
        all_edges = delete_parents(store.read("edges", EDGES), away).unionByName(edges)
        vector = ", vector array<float>"
        curriculum = anchor_records(sections).unionByName(step_records(steps))
        curriculum = delete_parents(store.read("curriculum", CURRICULUM + vector), away).unionByName(embedded(curriculum, provider, dim))
        questions = delete_parents(store.read("questions", QUESTIONS + vector), away).unionByName(embedded(question_records(pairs), provider, dim))
        concepts, relations = graph_tables(all_edges, all_sections)
        store.commit({"sections": all_sections, "edges": all_edges, "curriculum": curriculum, "questions": questions, "concepts": concepts, "relations": relations})
        for df in held:
            df.unpersist()
    fresh.unpersist()
    gone.unpersist()
    return n


def start(spark: SparkSession, path: str, store: SnapshotStore, checkpoint: str, provider: Provider | None = None, force: bool = False) -> StreamingQuery:
    """A stream of the Markdown files under ``path`` into the store."""
    files = spark.readStream.format("text").option("wholetext", True).load(path).select(basename(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("content"))
    return files.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest(df, store, provider, force) and None).start()

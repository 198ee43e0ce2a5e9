"""More queries over the driver's tables: records, lookups, reports, replies of models, evaluation, headings, files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import contracts as K
from quirework.functions import sql
from quirework.functions import text as T
from quirework.functions.providers import OfflineProvider
from quirework.operators import compile as C
from quirework.operators import evaluate as E
from quirework.operators import graph as G
from quirework.operators import reports as P
from quirework.operators import retrieval as V
from quirework.operators import sections as S
from quirework.plans.queries import _CON, _REL, _graph, query, spread, t
from quirework.sources import documents as D
from quirework.sources import records as R
from quirework.sources.documents import last_of_parent
from quirework.sources.records import QUESTIONS
from quirework.sources.store import SnapshotStore
from quirework.streaming.ingest import SECTIONS, asked, graph_tables, identified, ingest


def s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# Records: a supplier's parts are a paper's sections


_UUID = """substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::int % 4) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""
_SHA = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({n}))"


def _id(name: str) -> str:
    return _UUID.format(h=f"({_SHA.format(n=name)})")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return p.select(s("p_partkey").alias("parent_id"), F.concat(F.lit("doc"), s(F.col("p_partkey") % 5)).alias("source"), F.col("p_name").alias("section"), (F.col("p_partkey") % 7).cast("int").alias("seq_id"), F.col("p_type").alias("page_content"))


@query(f"""
select {_id("p_partkey || '_section'")} as id, p_partkey::varchar as parent_id, 'doc' || (p_partkey % 5) as source, 'section_anchor' as type, sha256(p_type) as content_hash from part
""")
def upsert_section(spark: SparkSession, d: str) -> DataFrame:
    return R.anchor_records(_sections(spark, d)).select("id", "parent_id", "source", "type", "content_hash")


@query(f"""
select {_id("p_partkey || '_step_' || (p_partkey % 3)")} as id, 'roadmap_step' as type, (p_partkey % 3)::int as seq_id, p_name as title, ['c' || (p_partkey % 4)] as concepts from part
union all select {_id("p_partkey || '_section'")}, 'section_anchor', (p_partkey % 7)::int, null, null from part where p_partkey % 2 = 0
""")
def upsert_curriculum(spark: SparkSession, d: str) -> DataFrame:
    """Steps and anchors of one write; half of the anchors of an earlier one are replaced, the other half deleted."""
    x = _sections(spark, d)
    steps = x.select("parent_id", "source", (F.col("parent_id").cast("long") % 3).cast("int").alias("seq_id"), F.col("section").alias("title"), F.col("page_content").alias("content_focus"), F.array(F.concat(F.lit("c"), s(F.col("parent_id").cast("long") % 4))).alias("concepts"))
    odd = x.filter("parent_id % 2 = 1")
    stored = R.delete_parents(R.anchor_records(x), odd)
    return R.upsert(stored, R.anchor_records(x.filter("parent_id % 2 = 0")).unionByName(R.step_records(steps))).select("id", "type", "seq_id", "title", "concepts")


@query(f"""
with q as (select doc_id::varchar as parent_id, source, x, row_number() over (partition by doc_id order by i) - 1 as nth from (
  select doc_id, source, unnest([lang || '?', ' ', source || '?']) as x, unnest([0, 1, 2]) as i from documents) where trim(x) <> '')
select {_id("parent_id || '_q_' || nth")} as id, parent_id, source, x as page_content, case when nth = 0 then 'k' else '' end as key_knowledge from q
""")
def upsert_questions(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda q, k: F.struct(q.alias("question"), F.lit(k).cast("string").alias("key_knowledge"))
    qa = F.array(pair(F.concat("lang", F.lit("?")), "k"), pair(F.lit(" "), "blank"), pair(F.concat("source", F.lit("?")), None))
    return R.question_records(t(spark, d, "documents").select(s("doc_id").alias("parent_id"), "source", qa.alias("qa"))).select("id", "parent_id", "source", "page_content", "key_knowledge")


@query("""
with e as (select c_nationkey::varchar as parent_id, c_custkey as nth, 'Is it ' || c_mktsegment || (case when c_custkey % 2 = 0 then '?' else ' ?!' end) as question, c_name as key_knowledge from customer)
select parent_id, nth, question, key_knowledge from (select *, row_number() over (partition by parent_id, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) order by nth) as r from e) where r = 1
""")
def distinct_questions(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("c_custkey") % 2 == 0, "?").otherwise(" ?!")
    return R.distinct_questions(t(spark, d, "customer").select(s("c_nationkey").alias("parent_id"), F.col("c_custkey").alias("nth"), F.concat(F.lit("Is it "), "c_mktsegment", end).alias("question"), F.col("c_name").alias("key_knowledge")))


@query("""
select p_partkey::varchar as parent_id, p_name as section, (p_partkey % 7)::int as seq_id from part where p_partkey % 5 = 3 order by seq_id
""")
def exact_sections(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_sections(R.anchor_records(_sections(spark, d)), "doc3", most=None).select("parent_id", "section", "seq_id")


@query("select p_partkey::varchar as parent_id, p_name as section, p_type as page_content from part where p_partkey = 17")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.section_of(R.anchor_records(_sections(spark, d)), "17").select("parent_id", "section", "page_content")


@query("""
select 'doc' || p_partkey % 5 as source, least(count(*), 1000)::bigint as sections, least(sum((p_partkey % 2)::int * 2), 10000)::bigint as questions from part group by 1
""")
def storage_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _sections(spark, d)
    qa = F.array(*[F.struct(F.lit(q).alias("question"), F.lit("").alias("key_knowledge")) for q in ("a", "b")])
    return R.storage_counts(R.anchor_records(x), R.question_records(x.filter("parent_id % 2 = 1").select("parent_id", "source", qa.alias("qa"))))


@query("select distinct 'doc' || (p_partkey % 5) as source from part")
def paper_names(spark: SparkSession, d: str) -> DataFrame:
    return R.paper_names(R.anchor_records(_sections(spark, d)))


# Reports: orders are sections, their lines candidates


def _counted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = t(spark, d, "orders").select(s("o_orderkey").alias("parent_id"), F.concat(F.lit("doc"), s(F.col("o_custkey") % 9)).alias("source"), s("o_orderkey").alias("section"), F.col("o_orderkey").alias("seq_id"), (F.col("o_custkey") % 9 < F.when(F.col("o_orderkey") % 2 == 0, 6).otherwise(3)).alias("compiled"))
    li = t(spark, d, "lineitem").withColumn("parent_id", s("l_orderkey"))
    return o, P.counters(li, li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'O' and l_returnflag = 'N' and l_linenumber < 3"))


_COUNTED = """c as (select l_orderkey, count(*) as a, count(*) filter (l_linestatus = 'O') as b, count(*) filter (l_linestatus = 'O' and l_returnflag = 'N' and l_linenumber < 3) as k from lineitem group by 1),
o as (select o_orderkey, o_custkey % 9 as s, o_custkey % 9 < case when o_orderkey % 2 = 0 then 6 else 3 end as compiled from orders)"""


@query(f"with {_COUNTED} select l_orderkey::varchar as parent_id, a as candidates, b as verifier_approvals, k as retained from c")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d)[1]


@query(f"""
with {_COUNTED} select (select count(*) from o where compiled) as compiled, (select count(*) from o where not compiled) as up_to_date, true as bibliography_omitted,
  sum(a)::bigint as candidate_relationships, sum(b)::bigint as approved_relationships, sum(k)::bigint as retained_relationships, 1.5::double as elapsed_seconds from c
""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    o, c = _counted(spark, d)
    return P.ingest_summary(o, c, o.select("source", (F.col("source") == "doc3").alias("bibliography_omitted")).distinct(), 1.5)


@query(f"""
with {_COUNTED} select 'doc' || s as source, coalesce(list(o_orderkey::varchar order by o_orderkey) filter (compiled), []) as sections_compiled, coalesce(list(o_orderkey::varchar order by o_orderkey) filter (not compiled), []) as sections_skipped,
  coalesce(sum(a) filter (compiled), 0)::bigint as candidates, coalesce(sum(b) filter (compiled), 0)::bigint as verifier_approvals, coalesce(sum(k) filter (compiled), 0)::bigint as retained,
  case when bool_and(compiled) then 'compiled' when bool_or(compiled) then 'partial' else 'skipped_already_current' end as ingestion_run_status, case when bool_or(compiled) then 'current_run' else 'not_current_run_skipped' end as graph_relationship_counts_scope
from o left join c on l_orderkey = o_orderkey group by s
""")
def source_report(spark: SparkSession, d: str) -> DataFrame:
    return P.source_report(*_counted(spark, d))


@query("""
with x as (select s_suppkey as k, s_suppkey % 4 as src, unnest([case when s_suppkey % 2 = 0 then 'Net ' || (s_suppkey % 6) else 'NET-' || (s_suppkey % 6) end, 'n' || (s_suppkey % 5), '?']) as n, unnest([0, 1, 2]) as i from supplier),
y as (select *, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) as key from x),
f as (select a.k, b.n, b.key, b.k * 10 + b.i as o, row_number() over (partition by a.k, b.key order by b.k, b.i) as r from (select distinct k, src from x) a join y b on a.src = b.src and b.k < a.k where b.key <> '')
select s_suppkey::varchar as parent_id, coalesce(list(n order by o) filter (r = 1), []) as known from supplier left join f on k = s_suppkey group by s_suppkey
""")
def paper_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    net = F.concat(F.when(k % 2 == 0, "Net ").otherwise("NET-"), s(k % 6))
    x = t(spark, d, "supplier").select(s(k).alias("parent_id"), s(k % 4).alias("source"), k.alias("seq_id"), F.array(net, F.concat(F.lit("n"), s(k % 5)), F.lit("?")).alias("anchor_nodes"))
    return P.paper_vocabulary(x).select("parent_id", "known")


# Replies of models


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of all kinds, by the remainder of the key by 6: a plan in a fence, one with words about it, a stray member, a
    list where an object should be, an object where a list should be, and no JSON."""
    k = F.col("p_partkey")
    plan = F.concat(F.lit('{"main_entities": ["E'), s(k % 11), F.lit('"], "learning_roadmap": [{"seq_id": 1, "title": "T'), s(k), F.lit('", "content_focus": "f", "concepts": []}]}'))
    reply = F.when(k % 6 == 0, F.concat(F.lit("```json\n"), plan, F.lit("\n```"))).when(k % 6 == 1, F.concat(F.lit("So: "), plan, F.lit(" as asked."))).when(k % 6 == 2, F.lit('{"main_entities": [], "more": 1}')).when(k % 6 == 3, F.lit("[1, 2]")).when(k % 6 == 4, F.lit('{"main_entities": {"a": 1}}')).otherwise("no idea")
    return t(spark, d, "part").select(k.alias("k"), reply.alias("reply"))


@query("""
select p_partkey as k, p_partkey % 6 < 2 as ok, case when p_partkey % 6 < 2 then ['E' || (p_partkey % 11)] end as main_entities, case when p_partkey % 6 < 2 then 'T' || p_partkey end as title from part
""")
def contract_plan(spark: SparkSession, d: str) -> DataFrame:
    x = _replies(spark, d).select("k", K.parse_plan(K.json_object(F.col("reply"))).alias("p"))
    return x.select("k", F.col("p").isNotNull().alias("ok"), "p.main_entities", F.get("p.learning_roadmap", F.lit(0))["title"].alias("title"))


@query("""
select p_partkey as k, list_concat(case when p_partkey % 3 > 0 then [p_partkey || ' USES t'] else [] end, ['s RELATES_TO ' || p_partkey]) as edges from part
""")
def contract_graph(spark: SparkSession, d: str) -> DataFrame:
    """Of four edges one has no evidence, one no target, and one, in a third of the replies, a relation that is none."""
    k = s("p_partkey")
    rel = F.when(F.col("p_partkey") % 3 > 0, "utilizes").otherwise("9?")
    text = F.concat(F.lit('{"knowledge_graph": {"nodes": [], "edges": [{"source": "'), k, F.lit('", "relation": "'), rel, F.lit('", "target": "t", "evidence_id": "e0"}, {"source": "a", "target": "b", "relation": "USES"}, {"source": "a", "relation": "USES", "evidence_id": "e1"}, {"source": "s", "target": "'), k, F.lit('", "evidence_id": "e2"}]}}'))
    x = t(spark, d, "part").select(F.col("p_partkey").alias("k"), K.parse_graph(text)["edges"].alias("e"))
    return x.select("k", F.transform("e", lambda e: F.concat_ws(" ", e["source"], e["relation"], e["target"])).alias("edges"))


@query("""
select p_partkey as k, case when p_partkey % 4 = 0 then range(p_partkey % 15)::int[] when p_partkey % 4 = 1 then [7, 7]::int[] end as approved from part where p_partkey % 4 > 0 or p_partkey % 15 < 13
union all select p_partkey, null from part where p_partkey % 4 = 0 and p_partkey % 15 >= 13
""")
def contract_verify(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    some = F.array_join(F.transform(F.when(k % 15 > 0, F.sequence(F.lit(0), (k % 15 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit('{"index": '), s(i), F.lit("}"))), ", ")
    inner = F.when(k % 4 == 0, some).when(k % 4 == 1, '{"index": 7}, {"index": 7}').when(k % 4 == 2, '{"index": "x"}')
    reply = F.when(k % 4 == 3, '{"approved": []}').otherwise(F.concat(F.lit('{"approvals": ['), inner, F.lit("]}")))
    return t(spark, d, "part").select(k.alias("k"), K.parse_approvals(reply, F.lit(12)).alias("approved"))


@query("""
with x as (select p_partkey as k, ['E' || (p_partkey % 3), ' E1 ', ''] as e, 'A-' || (p_partkey % 2) as a, 'a ' || (p_partkey % 2) as b from part),
n as (select k, unnest(list_concat(e, [a, b])) as n, unnest(range(5)) as i from x),
u as (select k, trim(n) as n, i, row_number() over (partition by k, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) order by i) as r from n where trim(n) <> '')
select k, list(n order by i) as nodes, 1::int as n_edges from u where r = 1 group by k
""")
def plan_with_local(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    plan = F.struct(F.array(F.concat(F.lit("E"), s(k % 3)), F.lit(" E1 "), F.lit("")).alias("main_entities"), F.array().cast(f"array<{K.STEP}>").alias("learning_roadmap"))
    edge = F.struct(F.concat(F.lit("A-"), s(k % 2)).alias("source"), F.lit("USES").alias("relation"), F.concat(F.lit("a "), s(k % 2)).alias("target"), F.lit("e0").alias("evidence_id"))
    x = t(spark, d, "part").select(k.alias("k"), K.plan_with_local(plan, F.array(edge))["knowledge_graph"].alias("g"))
    return x.select("k", F.transform("g.nodes", lambda n: n["name"]).alias("nodes"), F.size("g.edges").alias("n_edges"))


@query("""
select doc_id, case when n_chars % 3 = 0 then '(no evidence spans)' else '[e0] ' || lang || chr(10) || '[e1] ' || source end as spans, n_chars % 4 = 1 as whole_part from documents
""")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    span = F.when(n % 3 > 0, F.array(*[F.struct(F.lit(f"e{i}").alias("id"), F.col(c).alias("text")) for i, c in enumerate(("lang", "source"))]))
    cue = F.when(n % 4 == 1, "The adapter IS a\n part of: the net").when(n % 4 == 2, "a part of the net is used").otherwise("it is partly of use")
    return t(spark, d, "documents").select("doc_id", K.rendered_spans(span).alias("spans"), K.has_whole_part_cue(cue).alias("whole_part"))


@query("select doc_id, list_sort(['net ' || (doc_id % 3), 'adapter']) as names from documents")
def grounded_names(spark: SparkSession, d: str) -> DataFrame:
    k = s(F.col("doc_id") % 3)
    names = F.array(F.concat(F.lit("net "), k), F.concat(F.lit(" Net-"), k), F.lit("zzz"), F.lit("adapter"))
    whole = F.concat(F.lit("an adapter of net "), k)
    return t(spark, d, "documents").select("doc_id", F.array_sort(C.ground_names(names, whole)).alias("names"))


# Ranking and evaluation


class _Scripted:
    """A provider whose model and outside scores fail or answer as the query says."""

    def __init__(self, outside: bool) -> None:
        if outside:
            self.external_scores = lambda q, c: [float("nan")] * len(c) if "x" in q else [float(i) for i in range(len(c))]

    def rerank(self, query: str, candidates: list[dict]) -> list[str]:
        if "m" in query:
            raise RuntimeError("no answer")
        return ["unknown", candidates[0]["parent_id"]]


@query("""
select o_orderkey as k, case o_orderkey % 6 when 0 then 'llm' when 1 then 'vector' when 2 then 'llm_fallback' when 3 then 'external' when 4 then 'llm_fallback' else 'vector' end as rerank_source,
  case o_orderkey % 6 when 0 then ['a'] when 1 then ['a', 'b', 'c'] when 2 then ['c'] when 3 then ['c', 'b', 'a'] when 4 then ['a'] else ['a', 'b', 'c'] end as ids from orders
""")
def rerank_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A model that answers or fails; no outside scores, good ones, and ones that aren't numbers."""

    def one(keys):
        import pandas as pd

        cand = [{"parent_id": p} for p in "abc"]
        out = [V.cascade(("m" if k % 2 else "") + ("x" if k % 6 > 3 else ""), cand, _Scripted(k % 6 > 1)) for k in keys]
        return pd.DataFrame(out, columns=["ids", "rerank_source"])

    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.pandas_udf(one, "struct<ids:array<string>,rerank_source:string>")("o_orderkey").alias("r"))
    return x.select("k", "r.rerank_source", "r.ids")


@query("""
with e as (select l_orderkey as query_id, l_linenumber::varchar as parent_id, l_linenumber as place, case when l_orderkey % 5 = 0 and l_linenumber = 2 then null else max(l_quantity) end as score from lineitem group by l_orderkey, l_linenumber),
b as (select query_id, bool_or(score is null) as bad from e group by 1)
select query_id, parent_id, row_number() over (partition by query_id order by case when bad then 0 else -score end, place)::int as place from e join b using (query_id)
""")
def external_order(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    e = li.select(F.col("l_orderkey").alias("query_id"), s("l_linenumber").alias("parent_id"), F.col("l_linenumber").alias("place"), F.when(~((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 2)), F.col("l_quantity").cast("double")).alias("score"))
    return V.preordered(e.drop("score"), V.ranked_scores(e)).select("query_id", "parent_id", "place")


@query("""
with c as (select c_custkey as query_id, c_custkey % 4 as a, c_custkey % 6 as b from customer)
select query_id, case when b < 4 then [{'source': 'new' || a, 'section': 'Part one'}, {'source': 'new' || b, 'section': 'Part one'}] else [{'source': 'new' || a, 'section': 'Part one'}] end as expected, case when query_id % 3 = 0 then 'new' || a when query_id % 3 = 1 then '' else '' end as target_file from c
""")
def case_remap(spark: SparkSession, d: str) -> DataFrame:
    """Two expectations a case; the sources old4 and old5 aren't in the map, nor is the target file of a third of the cases."""
    k = F.col("c_custkey")
    e = lambda c: F.struct(F.concat(F.lit("old"), s(c)).alias("source"), F.lit("part ONE!").alias("section"))
    cases = t(spark, d, "customer").select(k.alias("query_id"), F.array(e(k % 4), e(k % 6)).alias("expected"), F.when(k % 3 == 0, F.concat(F.lit("old"), s(k % 4))).when(k % 3 == 1, "").otherwise("lost").alias("target_file"))
    names = spark.range(4).select(F.concat(F.lit("old"), s("id")).alias("source"), F.concat(F.lit("new"), s("id")).alias("mapped"))
    return E.remap_cases(cases, names, names.select(F.col("mapped").alias("source"), F.lit("Part one").alias("title")))[0].select("query_id", "expected", "target_file")


@query("select c_custkey as query_id, 'old' || (c_custkey % 6) as source, 'part ONE!' as section from customer where c_custkey % 6 > 3")
def case_unresolved(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cases = t(spark, d, "customer").select(k.alias("query_id"), F.array(F.struct(F.concat(F.lit("old"), s(k % 6)).alias("source"), F.lit("part ONE!").alias("section"))).alias("expected"), F.lit("").alias("target_file"))
    names = spark.range(4).select(F.concat(F.lit("old"), s("id")).alias("source"), F.concat(F.lit("new"), s("id")).alias("mapped"))
    return E.remap_cases(cases, names, names.select(F.col("mapped").alias("source"), F.lit("Part one").alias("title")))[1]


@query("select o_custkey as query_id, list(md5('doc' || (o_orderkey % 3) || '__' || o_orderpriority) order by o_orderkey) as expected from orders group by 1")
def expected_parents(spark: SparkSession, d: str) -> DataFrame:
    e = F.struct("o_orderkey", F.concat(F.lit("doc"), s(F.col("o_orderkey") % 3)).alias("source"), F.col("o_orderpriority").alias("section"))
    return E.expected_parents(t(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.array_sort(F.collect_list(e)).alias("expected")))


@query("""
select m as metric, round(b - a, 6) as delta from (select o_orderpriority as m, avg(o_totalprice::double) filter (o_orderkey % 2 = 0) as a, avg(o_totalprice::double) filter (o_orderkey % 2 = 1) as b from orders group by 1)
""")
def metric_comparison(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    of = lambda r: o.filter(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("value"))
    return E.compare_metrics(of(0), of(1)).withColumn("delta", F.round("delta", 6))


# The graph, counted


@query("with " + _CON + " select id from con")
def concept_names(spark: SparkSession, d: str) -> DataFrame:
    return G.concept_names(_graph(spark, d)[0])


@query("with " + _REL + " select source || ' —' || type || '→ ' || target as line from rel")
def relation_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.relation_lines(_graph(spark, d)[1].select("source", F.col("type").alias("relation"), F.lit("").alias("label"), "target"))


@query("""
select distinct 'S' || (l_suppkey % 50) as source, case when l_linenumber % 2 = 0 then l_returnflag else l_linestatus end as relation, 'P' || (l_partkey % 40) as target from lineitem where l_linenumber % 3 > 0
""")
def unique_edges(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    target = F.when(n % 3 > 0, F.concat(F.lit(" P"), s(F.col("l_partkey") % 40))).otherwise("  ")
    return G.unique_edges(t(spark, d, "lineitem").select(F.concat(F.lit("S"), s(F.col("l_suppkey") % 50)).alias("source"), F.when(n % 2 == 0, F.col("l_returnflag")).otherwise(" ").alias("relation"), F.col("l_linestatus").alias("label"), target.alias("target")))


@query("with " + _CON + """, s as (select unnest(['doc1', 'doc5', 'none']) as source), n as (select id, unnest(list_distinct([split_part(x, '::', 1) for x in source_locators])) as source from loc), r as (select unnest(list_distinct([split_part(x, '::', 1) for x in source_locators])) as source from rel)
select source, (select count(*) from n where n.source = s.source) as nodes, (select count(*) from r where r.source = s.source) as relationships from s
""")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.source_counts(*_graph(spark, d), ["doc1", "doc5", "none"])


# Headings, files, SQL


_TITLES = """(select doc_id as k, case doc_id % 8 when 0 then (doc_id % 9) || '.2 Of ' || lang when 1 then 'IV. Results of ' || source when 2 then 'Abstract:' when 3 then '2021 Report' when 4 then 'A.1 Appendix' when 5 then '7 References' when 6 then 'related work' else '3 Ends here.' end as c from documents)"""


@query(rf"""
with x as (select *, regexp_replace(lower(c), ':+$', '') as key, regexp_matches(c, '^(\d+(\.\d+)*|[IVXLC]+)[.)]?\s+[A-Z][A-Za-z0-9 .,:;()/_-]{{1,100}}$') and not regexp_matches(c, '^\d{{4}}\b') and not regexp_matches(c, '[.?!]$') as num from {_TITLES}),
y as (select *, num or key in ('abstract', 'related work') as paper from x)
select k, num as numbered, paper, num or key = 'abstract' as body, paper or regexp_matches(c, '^[A-Z](\.\d+)*[.)]?\s+[A-Z]') as section, k % 8 = 5 as refs from y
""")
def heading_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    c = F.when(k % 8 == 0, F.concat(s(k % 9), F.lit(".2 Of "), "lang")).when(k % 8 == 1, F.concat(F.lit("IV. Results of "), "source"))
    for i, x in ((2, "Abstract:"), (3, "2021 Report"), (4, "A.1 Appendix"), (5, "7 References"), (6, "related work")):
        c = c.when(k % 8 == i, x)
    x = t(spark, d, "documents").select(k.alias("k"), c.otherwise("3 Ends here.").alias("c"))
    c = F.col("c")
    return x.select("k", T.is_numbered_heading(c).alias("numbered"), T.is_paper_heading(c).alias("paper"), T.starts_body(c).alias("body"), T.is_section_heading(c).alias("section"), T.is_references_heading(c).alias("refs"))


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """A paper a part, in Markdown: a title, an abstract, a method, references, and an appendix for every other one."""
    k = F.col("p_partkey")
    long = F.repeat(F.concat("p_name", F.lit(" and so on.\n")), 20)
    end = F.when(k % 2 == 0, F.concat(F.lit("# A Appendix\n"), long)).otherwise("")
    text = F.concat(F.lit("# "), "p_name", F.lit("\nwho wrote it\n# Abstract\n"), long, F.lit("# 1 Method\n"), long, F.lit("## About that\n"), long, F.lit("# References\n[1] one\n"), end)
    return spread(t(spark, d, "part").select("p_partkey", "p_name")).select(s(k).alias("source"), text.alias("content"), F.lit("a.pdf").alias("origin_source"), F.array(F.lit("1-9")).alias("page_ranges"))


_LONG = "trim(repeat(p_name || ' and so on.' || chr(10), 20), chr(10))"


@query(f"""
with p as (select *, {_LONG} as long from part)
select p_partkey::varchar as source, unnest(list_concat(['Abstract', '1 Method'], case when p_partkey % 2 = 0 then ['A Appendix'] else [] end)) as section, unnest(range(3))::int as seq_id,
  unnest(list_concat([long, long || chr(10) || 'About that' || chr(10) || long], case when p_partkey % 2 = 0 then [long] else [] end)) as page_content from p
""".replace("unnest(range(3))", "unnest(range(case when p_partkey % 2 = 0 then 3 else 2 end))"))
def split_converted(spark: SparkSession, d: str) -> DataFrame:
    return S.split_converted(_papers(spark, d))[0].select("source", "section", "seq_id", "page_content")


@query("select p_partkey::varchar as source, case when p_partkey % 2 = 0 then 3 else 2 end::bigint as retained_section_count, true as bibliography_omitted from part")
def parse_report(spark: SparkSession, d: str) -> DataFrame:
    return S.parse_report(*S.split_converted(_papers(spark, d)))


@query("""
select p_partkey::varchar as source, unnest(['Abstract', '1 Method']) as section, unnest([0, 1])::int as seq_id, unnest([1, 1])::int as page_start, unnest([1, 2])::int as page_end, unnest([p_name, p_type || chr(10) || p_brand]) as page_content from part
""")
def split_pages(spark: SparkSession, d: str) -> DataFrame:
    first = F.concat(F.lit("A title\nAbstract\n"), "p_name", F.lit("\n1 Method\n "), "p_type")
    pages = F.array(first, F.concat("p_brand", F.lit("\n\nReferences\n[1] one")), F.lit("2 More\nleft out"))
    return S.split_pages(t(spark, d, "part").select(s("p_partkey").alias("source"), pages.alias("pages")))[0].select("source", "section", "seq_id", "page_start", "page_end", "page_content")


@query("""
select o_orderkey as k, case o_orderkey % 7 when 1 then 'incomplete' when 2 then 'no chunks' when 3 then 'unfinished' when 4 then 'doesn''t cover the pages' when 5 then 'belongs to another document' when 6 then 'no source' end as problem from orders
""")
def manifest_gate(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("o_orderkey") % 7
    chunk = lambda a, b, state: F.struct(F.lit(f"{a}-{b}").alias("page_range"), F.lit(a).alias("start_page"), F.lit(b).alias("end_page"), F.lit("t").alias("task_id"), state.alias("state"), F.lit(None).cast("string").alias("error"))
    done = F.lit("done")
    chunks = F.when(r == 2, F.array().cast(f"array<{D.CHUNK}>")).when(r == 4, F.array(chunk(1, 3, done))).otherwise(F.array(chunk(1, 3, done), chunk(4, 4, F.when(r == 3, "failed").otherwise(done))))
    m = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(r == 6, " ").otherwise("a.pdf").alias("source"), F.lit(4).alias("page_count"), (r != 1).alias("complete"), F.lit(False).alias("partial"), chunks.alias("chunks"), F.when(r == 5, "out/other.md").otherwise(F.concat(F.lit("out/"), s("o_orderkey"), F.lit(".md"))).alias("markdown_path"), s("o_orderkey").alias("stem"))
    return D.manifest_problem(m).select("k", "problem")


@query("""
select l_orderkey::varchar as source, string_agg('p' || l_linenumber, chr(10) || chr(10) order by l_linenumber) filter (l_returnflag <> 'R') as content, bool_and(l_returnflag <> 'R') as complete from lineitem group by 1
""")
def merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    x = t(spark, d, "lineitem").select(s("l_orderkey").alias("source"), n.alias("start_page"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("state"), F.concat(F.lit("p"), s(n)).alias("markdown"))
    return D.merge_chunks(x).withColumn("content", F.nullif("content", F.lit("")))


@query("""
select p_name || '.' || x as source, case x when 'md' then 'ingest' when 'PDF' then 'extract' when 'Markdown' then 'ingest' else 'refuse' end as route from (select p_name, ['md', 'PDF', 'Markdown', 'docx'][p_partkey % 4 + 1] as x from part)
""")
def routed_files(spark: SparkSession, d: str) -> DataFrame:
    x = F.element_at(F.array(*map(F.lit, ("md", "PDF", "Markdown", "docx"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return D.routed(t(spark, d, "part").select(F.concat("p_name", F.lit("."), x).alias("source")))


@query("""
select doc_id, 'It is so ' || case when doc_id % 2 = 0 then '[a — 1]' else '' end || ' and so .' as answer, '[key] at [url] no' as message from documents
""".replace("[key]", "[redacted]"))
def citations_and_errors(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 2 == 0, "[a — 1]").otherwise("[b — 2]")
    answer = T.known_citations(F.concat(F.lit("It is so "), mark, F.lit(" and so [c].")), F.array(F.lit("[a — 1]")))
    return t(spark, d, "documents").select("doc_id", answer.alias("answer"), T.redacted(F.concat(F.lit("k3y at https://h/x?d="), s("doc_id"), F.lit(" no")), "k3y").alias("message"))


@query(r"""
select p_partkey as k, case p_partkey % 5 when 0 then 'USES' when 1 then 'USES' when 2 then 'BASED_ON' when 3 then '' else 'PART_' || p_partkey end as relation, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') as phrase, p_partkey % 5 = 1 as endpoint from part
""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions by SQL, on labels with white space of all kinds about them."""
    sql.register(spark)
    k = F.col("p_partkey")
    label = F.when(k % 5 == 0, "USES\n").when(k % 5 == 1, "\t uses ").when(k % 5 == 2, "Based On").when(k % 5 == 3, "9 lives").otherwise(F.concat(F.lit("part  "), s(k)))
    x = t(spark, d, "part").select(k.alias("k"), label.alias("label"), "p_name", F.when(k % 5 == 1, "adapter net").otherwise("the").alias("name"))
    return x.selectExpr("k", "normalize_relation(label) as relation", "normalized_phrase(p_name) as phrase", "is_concept_endpoint(name) as endpoint")


# Ingest: regions are documents, and their nations sections


def _store(spark: SparkSession) -> SnapshotStore:
    """A new store in the folder that executors share; a session of one machine may have a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return SnapshotStore(spark, f"{folder or tempfile.mkdtemp(prefix='quirework-')}/store-{uuid.uuid4().hex}")


def _regions(spark: SparkSession, d: str, some: str = "true") -> DataFrame:
    body = F.concat(F.lit("# "), "n_name", F.lit("\n"), F.repeat(F.concat(F.lit("The adapter method uses a compact net of "), "n_name", F.lit(".\n")), 8))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", body.alias("x")))), lambda r: r["x"]), "\n")
    n = t(spark, d, "nation").filter(some)
    return n.groupBy(F.concat(F.lit("r"), s("n_regionkey"), F.lit(".md")).alias("source")).agg(text.alias("content"))


def _cut(spark: SparkSession, d: str, some: str = "true") -> DataFrame:
    return last_of_parent(identified(S.split_markdown(_regions(spark, d, some))))


@query("""
with s as (select 'r' || n_regionkey || '.md' as source, n_name as section from nation where n_regionkey = 0 or n_nationkey % 3 > 0)
select source, section, 1::bigint as n_questions from s
""")
def ingest_stale(spark: SparkSession, d: str) -> DataFrame:
    """Two runs; in the second a third of the sections is gone, and the first region isn't given again."""
    store = _store(spark)
    ingest(_regions(spark, d), store)
    ingest(_regions(spark, d, "n_regionkey > 0 and n_nationkey % 3 > 0"), store)
    asked_ = store.read("questions", QUESTIONS).groupBy("parent_id").agg(F.count("*").alias("n_questions"))
    return store.read("sections", SECTIONS).join(asked_, "parent_id").select("source", "section", "n_questions")


@query("""
with s as (select md5('r' || n_regionkey || '.md__' || n_name) as parent_id, 'r' || n_regionkey || '.md' as source, n_name from nation)
select parent_id, source, 'What is said of The adapter method uses a compact?' as page_content, 'The adapter method uses a compact net of ' || n_name || '.' as key_knowledge from s
""")
def ingest_questions(spark: SparkSession, d: str) -> DataFrame:
    pairs = asked(_cut(spark, d), OfflineProvider())
    return R.question_records(pairs).select("parent_id", "source", "page_content", "key_knowledge")


@query("""
with s as (select 'r' || n_regionkey || '.md' as source, 'r' || n_regionkey || '.md::' || n_name as locator, row_number() over (partition by n_regionkey order by n_nationkey) as seq, n_name from nation)
select 'adapter method' as id, list(locator order by source, seq) as source_locators from s
""")
def concepts_from_compile(spark: SparkSession, d: str) -> DataFrame:
    """Of the concepts that compiling leaves, the source of all its relations."""
    sections = _cut(spark, d).withColumn("anchor_nodes", F.array().cast("array<string>"))
    concepts, _ = graph_tables(C.compile_relations(sections)["edges"], sections)
    return concepts.filter("id = 'adapter method'").select("id", "source_locators")

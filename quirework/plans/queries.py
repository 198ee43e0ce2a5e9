"""A query for each operator over the driver's tables, and the SQL that gives the same rows.

The tables hold no research papers, so concepts, relations, questions and headings are made of what they do hold.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import markdown as M
from quirework.functions import relations as R
from quirework.functions import text as T
from quirework.functions.providers import OfflineProvider
from quirework.functions.vocab import CANONICAL_OF
from quirework.operators import compile as C
from quirework.operators import evaluate as E
from quirework.operators import graph as G
from quirework.operators import retrieval as V
from quirework.operators import sections as S
from quirework.operators import spans as P
from quirework.sources import documents as D
from quirework.sources import store as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A table in parts of about so many rows. A small file is one part otherwise, and so are the long texts made of its rows."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


# Identity and text


@query("""
select md5(source || '__' || doc_id) as parent_id, sha256(text) as content_hash, source || '::' || doc_id as locator from documents
""")
def parent_ids(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").withColumn("section", F.col("doc_id").cast("string"))
    return x.select(T.parent_id(F.col("source"), F.col("section")).alias("parent_id"), T.content_hash(F.col("text")).alias("content_hash"), T.locator(F.col("source"), F.col("section")).alias("locator"))


@query("""
select doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) as phrase from documents
""")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", T.normalized_phrase(F.col("text")).alias("phrase"))


@query("""
select source, count(*) as n, sum((length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 200)::int)::bigint as thin from documents group by source
""")
def thin_sections(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").withColumn("thin", C.is_thin(F.col("text")).cast("int"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.sum("thin").alias("thin"))


@query("""
select doc_id, case when length(text) <= 600 then text else
  regexp_replace(substr(text, 1, 280), '\\s+$', '') || chr(10) || '[... the middle part is left out ... ]' || chr(10) || regexp_replace(substr(text, length(text) - 279), '^\\s+', '') end as bounded
from documents
""")
def bounded_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", T.bounded_text(F.col("text"), 600).alias("bounded"))


_LABELS = [*CANONICAL_OF, "uses", "relies on", "tested-on", " fine tunes ", "not a relation!", "???", "", "__has__", "9x", "evaluated on"]


@query("with a(alias, name) as (values " + ", ".join(f"('{a}', '{n}')" for a, n in CANONICAL_OF.items()) + "), l(i, label) as (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_LABELS)) + f"""),
e as (select event_id, label, regexp_replace(regexp_replace(regexp_replace(upper(trim(label)), '[ -]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as raw
  from events join l on event_id % {len(_LABELS)} = i)
select coalesce(name, case when regexp_full_match(raw, '[A-Z][A-Z0-9_]{{0,63}}') then raw else '' end) as relation, count(*) as n
from e left join a on raw = alias group by all
""")
def relation_normalize(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("event_id") % len(_LABELS)).cast("int") + 1)
    return t(spark, d, "events").select(R.normalize_relation(label).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


# Sections


@query("""
with l as (select page_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line from (
    select page_id, string_split(regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '<p>|<footer>', chr(10) || '## Part' || chr(10), 'g'), chr(10)) as ls from pages)),
m as (select *, regexp_matches(line, '^#{1,2}\\s+\\S') as h from l),
g as (select *, sum(h::int) over w as part, coalesce(last_value(case when h then regexp_replace(regexp_extract(line, '^#{1,2}\\s+(.+)$', 1), '\\s*#*\\s*$', '') end ignore nulls) over w, 'Introduction') as section
  from m window w as (partition by page_id order by pos rows unbounded preceding)),
s as (select page_id, part, min(pos) as pos, any_value(section) as section, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as body from g where not h group by all having regexp_replace(string_agg(line, ''), '\\s', '', 'g') <> ''),
k as (select *, length(body) >= 200 or lead(pos) over (partition by page_id order by pos) is null as keep from s),
u as (select *, sum(keep::int) over (partition by page_id order by pos rows between current row and unbounded following) as unit from k)
select 'page' || page_id as source, arg_max(section, pos) as section, (row_number() over (partition by page_id order by max(pos)) - 1)::int as seq_id,
  string_agg(case when keep then body else section || chr(10) || body end, chr(10) order by pos) as page_content from u group by page_id, unit
""")
def section_split_html(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "<p>|<footer>", "\n## Part\n")
    docs = t(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("source"), text.alias("content"))
    return S.split_markdown(docs).select("source", "section", "seq_id", "page_content")


@query("""
with s as (select conv_id, turn, role, text, length(text) >= 200 or turn = max(turn) over (partition by conv_id) as keep from conversations),
u as (select *, sum(keep::int) over (partition by conv_id order by turn rows between current row and unbounded following) as unit from s)
select conv_id, arg_max(role, turn) as section, string_agg(case when keep then text else role || chr(10) || text end, chr(10) order by turn) as page_content,
  (row_number() over (partition by conv_id order by max(turn)) - 1)::int as seq_id from u group by conv_id, unit
""")
def section_merge_turns(spark: SparkSession, d: str) -> DataFrame:
    parts = t(spark, d, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("pos"), F.col("role").alias("section"), F.col("text").alias("page_content"))
    return S.numbered(S.merge_stubs(parts)).withColumnRenamed("source", "conv_id")


@query("""
with r as (select 'part' || p_partkey as source, p_size as n from part)
select source, s as start_page, least(s + 9, n)::int as end_page from (select source, n, unnest(range(1, n + 1, 10))::int as s from r)
""")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return D.page_ranges(t(spark, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("source"), F.col("p_size").alias("page_count")))


@query()
def evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("page_content"))
    return P.with_windows(x)


# Relations


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that state relations, of names of parts: one section for each part, padded beyond the thin limit."""
    p = spread(t(spark, d, "part").select("p_partkey"))
    key = F.col("p_partkey").cast("string")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("uses", "is based on", "requires", "improves", "is a component of", "is evaluated on")]), (F.col("p_partkey") % 6).cast("int") + 1)
    text = F.concat(F.lit("Model M"), key, F.lit(" "), verb, F.lit(" the method K"), key, F.lit(". "), F.repeat(F.lit("Nothing else is said in this place. "), 6))
    return p.select(key.alias("parent_id"), F.lit("parts.md").alias("source"), F.concat(F.lit("S"), key).alias("section"), F.col("p_partkey").cast("int").alias("seq_id"), text.alias("page_content"))


_REL_SQL = "case p_partkey % 6 when 0 then 'USES' when 1 then 'BASED_ON' when 2 then 'REQUIRES' when 3 then 'IMPROVES' when 4 then 'PART_OF' else 'EVALUATED_ON' end"


@query(f"""
select p_partkey::varchar as parent_id, i as idx, 'Model M' || p_partkey as source, {_REL_SQL} as relation, 'method K' || p_partkey as target, e as evidence_id
from part, (values (0, 'e0'), (1, 'e0+e1')) v(i, e)
""")
def local_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.local_candidates(P.with_windows(_sentences(spark, d)))


@query(f"""
select p_partkey::varchar as parent_id, 'Model M' || p_partkey as source, {_REL_SQL} as relation, 'method K' || p_partkey as target, 'e0' as evidence_id from part
""")
def compiled_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.compile_relations(_sentences(spark, d))["edges"].select("parent_id", "source", "relation", "target", "evidence_id")


@query("""
with c as (select p_partkey, p_partkey % 8 as k from part)
select reason, count(c.k)::bigint as n from (values ('duplicate_approval', 1), ('invalid_approval', 0), ('invalid_endpoint', 4), ('invalid_evidence_id', 2), ('relation_mismatch', 5), ('relation_mismatch', 6), ('span_grounding', 3)) r(reason, v)
left join (select k from c union all select k from c where k = 1) c on c.k = r.v group by reason
""")
def approval_gate(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    k = F.col("p_partkey") % 8
    key = F.col("p_partkey").cast("string")
    name = F.when(k == 4, "where").otherwise(F.concat(F.lit("Model M"), key))
    rel = F.when(k == 5, "not a relation!").when(k == 6, "TRAINED_ON").otherwise(F.element_at(F.array(*[F.lit(r) for r in ("USES", "BASED_ON", "REQUIRES", "IMPROVES", "PART_OF", "EVALUATED_ON")]), (F.col("p_partkey") % 6).cast("int") + 1))
    part = t(spark, d, "part")
    cand = part.select(key.alias("parent_id"), F.lit(0).alias("idx"), name.alias("source"), rel.alias("relation"), F.concat(F.lit("method K"), key).alias("target"), F.when(k == 2, "e99").when(k == 3, "e1").otherwise("e0").alias("evidence_id"))
    ok = part.select(key.alias("parent_id"), F.when(k == 0, 7).otherwise(0).alias("idx"), F.col("p_partkey").alias("seq"), F.explode(F.when(k == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")).drop("time")
    return C.rejections(C.judge(cand, ok, P.with_windows(s), s))


@query("""
with e as (select l_orderkey::varchar as parent_id, (l_linenumber * 2100 + l_partkey % 2100) * 101 + l_suppkey % 101 as idx, 'S' || (l_suppkey % 3) as source, case when l_returnflag = 'A' then 'USES' when l_returnflag = 'N' then 'BASED_ON' else 'REQUIRES' end as relation,
    'P' || (l_partkey % 2) as target, case when l_linenumber % 2 = 0 then 'e0+e1' else 'e' || l_linenumber end as evidence_id, l_linestatus = 'O' as is_local from lineitem),
p as (select *, (2 * is_local::int + (evidence_id not like '%+%')::int) as pref, (not is_local)::bigint * 100000000 + idx as seen from e),
b as (select *, row_number() over (partition by parent_id, source, relation, target order by pref desc, seen) as nth, min(seen) over (partition by parent_id, source, relation, target) as place from p),
o as (select *, row_number() over (partition by parent_id order by place) - 1 as i from b where nth = 1)
select parent_id, i::int as idx, source, relation, target, evidence_id, is_local from o where i < 12
""")
def union_candidates(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("parent_id"), ((F.col("l_linenumber") * 2100 + F.col("l_partkey") % 2100) * 101 + F.col("l_suppkey") % 101).cast("int").alias("idx"), F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("source"), F.when(F.col("l_returnflag") == "A", "employs").when(F.col("l_returnflag") == "N", "Based On").otherwise("REQUIRES").alias("relation"), F.concat(F.lit(" P"), (F.col("l_partkey") % 2).cast("string")).alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "e0+e1").otherwise(F.concat(F.lit("e"), F.col("l_linenumber").cast("string"))).alias("evidence_id"), "l_linestatus")
    return C.union_candidates(x.filter("l_linestatus = 'O'"), x.filter("l_linestatus <> 'O'"))


# The graph: suppliers and parts of the lines of orders


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string")).alias("s"), F.concat(F.lit("P"), (F.col("l_partkey") % 400).cast("string")).alias("p"), "l_returnflag", F.concat(F.lit("doc"), (F.col("l_orderkey") % 7).cast("string"), F.lit("::sec"), (F.col("l_orderkey") % 3).cast("string")).alias("locator"))
    ord_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rel = F.when(F.col("l_returnflag") == "A", "uses").when(F.col("l_returnflag") == "N", "extends").otherwise("PREREQUISITE_OF")
    relations = G.merge_relations(li.select(ord_.alias("ord"), F.col("s").alias("source"), rel.alias("type"), F.col("p").alias("target"), "locator"))
    ends = li.select((ord_ * 2).alias("ord"), F.col("s").alias("id"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("supplier of order "), F.col("l_orderkey").cast("string"))).otherwise("").alias("description"), (F.col("l_returnflag") == "R").alias("is_main"), "locator")
    other = li.select((ord_ * 2 + 1).alias("ord"), F.col("p").alias("id"), F.lit("").alias("description"), F.lit(False).alias("is_main"), "locator")
    return G.merge_concepts(ends.unionByName(other)), relations


_LI = """li as (select l_orderkey, l_linenumber, 'S' || (l_suppkey % 50) as s, 'P' || (l_partkey % 400) as p, l_returnflag, 'doc' || (l_orderkey % 7) || '::sec' || (l_orderkey % 3) as locator,
    case when l_returnflag = 'A' then 'USES' when l_returnflag = 'N' then 'BASED_ON' else 'PREREQUISITE_OF' end as type, l_orderkey * 10 + l_linenumber as ord from lineitem)"""
_REL = _LI + """, rel as (select source, type, target, list(locator order by f) as source_locators from (select s as source, type, p as target, locator, min(ord) as f from li group by all) group by all)"""
_CON = _REL + """, sight as (select ord * 2 as ord, s as id, case when l_linenumber = 1 then 'supplier of order ' || l_orderkey else '' end as description, l_returnflag = 'R' as is_main, locator from li
    union all select ord * 2 + 1, p, '', false, locator from li),
con as (select id, coalesce(arg_max(description, ord) filter (description <> ''), '') as description, bool_or(is_main) as is_main from sight group by id),
loc as (select id, list(locator order by f) as source_locators from (select id, locator, min(ord) as f from sight group by all) group by id)"""


@query("with " + _CON + " select id, description, is_main, source_locators from con join loc using (id)")
def concept_merge(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


@query("with " + _REL + " select source, type, target, source_locators from rel")
def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


@query("with " + _REL + " select source, type, target, list_filter(source_locators, lambda x: x <> 'doc1::sec1') as source_locators from rel where source_locators <> ['doc1::sec1']")
def provenance_delete(spark: SparkSession, d: str) -> DataFrame:
    return G.remove_locator(*_graph(spark, d), "doc1::sec1")[1]


def _names(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("S"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("P"), (F.col("id") * 7).cast("string"))).alias("name"))


_N = _CON + """, names as (select case when i % 2 = 0 then 'S' || i else 'P' || (i * 7) end as name from range(20) r(i))"""
_OUT = """select distinct r.source, a.description as source_desc, r.type as relation, r.target, b.description as target_desc from rel r join con a on a.id = r.source join con b on b.id = r.target where """
_D2 = "len(list_filter(source_locators, lambda x: starts_with(x, 'doc2::'))) > 0"


@query("with " + _N + _OUT + "r.target in (select name from names)")
def graph_semi_search(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_context(*_graph(spark, d), _names(spark), "semi_search")


@query("with " + _N + _OUT + "(r.target in (select name from names) or r.source in (select name from names)) and " + _D2)
def graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_context(*_graph(spark, d), _names(spark), "one_hop", "doc2")


@query("with " + _N + ", few as (select name from names where name in ('S0', 'P7')), wide as (select name from few union select target from rel where source in (select name from few) union select source from rel where target in (select name from few)) " + _OUT + "(r.target in (select name from wide) or r.source in (select name from wide)) and " + _D2)
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_context(*_graph(spark, d), _names(spark).filter("name in ('S0', 'P7')"), "search", "doc2")


@query("with " + _CON + " select id, description, source_locators, is_main from con join loc using (id) where list_contains(source_locators, 'doc3::sec1')")
def visual_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.visual_graph(*_graph(spark, d), locator="doc3::sec1")[0]


@query("with " + _REL + " select source, type as label, target from rel where " + _D2.replace("doc2", "doc4"))
def visual_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.visual_graph(*_graph(spark, d), source="doc4")[1]


@query("""
with recursive chain as (select p_partkey as a, p_partkey + 1 + p_partkey % 3 as b from part),
up(x, n) as (select a, 1 from chain where b = 50 union select c.a, n + 1 from chain c join up on c.b = up.x where n < 4),
down(x, n) as (select b, 1 from chain where a = 50 union select c.b, n + 1 from chain c join down on c.a = down.x where n < 4)
select (select list_sort(list(distinct 'part' || x)) from up) as prerequisites, (select list_sort(list(distinct 'part' || x)) from down) as leads_to, list_sort(['part48', 'part52']) as related_concepts
""")
def concept_subgraph(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("part"), c.cast("string"))
    p = t(spark, d, "part")
    k = F.col("p_partkey")
    pre = p.select(name(k).alias("source"), F.lit("PREREQUISITE_OF").alias("type"), name(k + 1 + k % 3).alias("target"))
    rel = p.select(name(k).alias("source"), F.lit("RELATES_TO").alias("type"), name(k + 2).alias("target"))
    return G.concept_subgraph(p.select(name(k).alias("id")), pre.unionByName(rel), "part50", 4)


@query("with " + _REL + """, e as (select row_number() over (order by source, type, target) as o, * from rel where source in ('S1', 'S2') and target in ('P1', 'P2', 'P101', 'P102', 'P202', 'P301')),
n as (select name, row_number() over (order by min(spot)) - 1 as i from (select source as name, o * 2 as spot from e union all select target, o * 2 + 1 from e) group by name)
select 'graph LR' || coalesce(chr(10) || string_agg('  n' || a.i || '["' || source || '"] -->|' || type || '| n' || b.i || '["' || target || '"]', chr(10) order by o), '') || chr(10) || '  n' || (select count(*) from n) || '["lone #40;x#41;"]' as diagram
from e join n a on a.name = source join n b on b.name = target
""")
def mermaid(spark: SparkSession, d: str) -> DataFrame:
    e = _graph(spark, d)[1].filter("source in ('S1', 'S2') and target in ('P1', 'P2', 'P101', 'P102', 'P202', 'P301')")
    e = e.select(F.row_number().over(Window.orderBy("source", "type", "target")).alias("ord"), "source", F.col("type").alias("label"), "target")
    return G.mermaid(e, spark.createDataFrame([(1, "lone (x)")], "ord int, id string"))


# Retrieval and metrics: every embedding is a question, its parent one of fifty sections


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = t(spark, d, "embeddings")
    pts = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("src"), (F.col("vec_id") % 4).cast("string")).alias("source"))
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 5 == 0, "src1").alias("target_file")), pts


_KNN = """k as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from (
  select q.vec_id as query_id, p.vec_id as id, round(list_cosine_similarity(p.embedding::double[], q.embedding::double[]), 6) as score
  from embeddings q, embeddings p where (q.vec_id % 5 <> 0 or p.vec_id % 4 = 1)))"""
_COLLAPSED = _KNN + """, h as (select query_id, 'p' || (id % 50) as parent, min(rank) as rank from k where rank <= 25 group by all),
c as (select *, row_number() over (partition by query_id order by rank) as place from h)"""


@query("with " + _KNN + " select query_id, id, score, rank::int as rank from k where rank <= 25")
def knn_questions(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(*_points(spark, d), digits=6)


@query("with " + _KNN + " select query_id, id, score, rank::int as rank from k where rank <= 5")
def knn_baseline(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(*_points(spark, d), k=5, digits=6)


def _collapsed(spark: SparkSession, d: str) -> DataFrame:
    hits = V.nearest(*_points(spark, d), digits=6).withColumn("parent_id", F.concat(F.lit("p"), (F.col("id") % 50).cast("string")))
    return V.collapse(hits)


@query("with " + _COLLAPSED + """, l as (select query_id, list(parent order by place) as v, list(parent order by parent desc) filter (query_id % 3 > 0) as r from c where place <= 5 group by query_id)
select query_id, unnest(case when r is null then v[1:2] when r[1] <> v[1] then [r[1], v[1]] else r[1:2] end) as parent_id, unnest(range(1, 3))::int as place from l where len(v) > 1
""")
def collapse_fuse(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: nearest questions, their parents, a rerank (names in falling order; none for each third query), fusion."""
    c = _collapsed(spark, d)
    w = c.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parent_id"))), lambda x: x["parent_id"]).alias("v"))
    reranked = F.when(F.col("query_id") % 3 > 0, F.reverse(F.array_sort("v")))
    rows = w.filter(F.size("v") > 1).select("query_id", F.posexplode(V.fuse(F.col("v"), reranked)).alias("place", "parent_id"))
    return rows.select("query_id", "parent_id", (F.col("place") + 1).alias("place"))


@query("with " + _COLLAPSED + """, l as (select query_id, list(parent order by place) as ranked, ['p' || (query_id * 7 % 50), 'p' || (query_id % 50)] as want from c where place <= 5 group by query_id),
m as (select *, list_min(list_filter([case when list_contains(want, ranked[i]) then i end for i in range(1, len(ranked) + 1)], lambda x: x is not null)) as first from l)
select avg((len(list_intersect(ranked[1:5], want)) > 0)::int)::double as recall_at_5, round(avg(coalesce(1.0::double / first, 0)), 9) as mrr from m
""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    want = F.array(F.concat(F.lit("p"), (F.col("query_id") * 7 % 50).cast("string")), F.concat(F.lit("p"), (F.col("query_id") % 50).cast("string")))
    r = _collapsed(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parent_id"))), lambda x: x["parent_id"]).alias("ranked")).withColumn("expected", want)
    return E.baseline_metrics(r).select("recall_at_5", F.round("mrr", 9).alias("mrr"))


@query("with " + _COLLAPSED + """, l as (select query_id, list(parent order by place) as r, list_distinct(['p' || (query_id * 7 % 50), 'p' || (query_id % 50)]) as want from c where place <= 5 group by query_id),
m as (select *, case when list_contains(want, r[1]) then 1.0 when list_contains(want, r[2]) then 0.5 else 0.0 end as rr from l)
select round(avg(len(list_intersect(list_distinct(r[1:2]), want)) / len(want)::double), 9) as recall_at_2, avg(rr)::double as mrr, avg((query_id % 2 = 0)::int)::double as all_expected_sources_rate,
  0.5::double as average_retrieval_latency_seconds, avg(query_id % 4)::double as average_graph_edges from m
""")
def runtime_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_id")
    want = F.array(F.concat(F.lit("p"), (q * 7 % 50).cast("string")), F.concat(F.lit("p"), (q % 50).cast("string")))
    r = _collapsed(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parent_id"))), lambda x: x["parent_id"]).alias("ranked")).withColumn("expected", want)
    r = r.withColumn("returned_sources", F.array(F.lit("dir/a.md"), F.lit(""))).withColumn("expected_sources", F.when(q % 2 == 0, F.array(F.lit("a.md"))).otherwise(F.array(F.lit("a.md"), F.lit("b.md")))).withColumn("latency", F.lit(0.5)).withColumn("graph_edges", q % 4)
    return E.runtime_metrics(r).withColumn("recall_at_2", F.round("recall_at_2", 9))


@query("""
select s as rerank_source, count(v)::double / (select count(*) from events) as rate from (values ('external'), ('llm_fallback'), ('llm'), ('vector')) d(s)
left join (select case when value > 50 then 'llm' else 'vector' end as v from events) e on e.v = d.s group by s
""")
def rerank_rates(spark: SparkSession, d: str) -> DataFrame:
    return E.rerank_rates(t(spark, d, "events").select(F.when(F.col("value") > 50, "llm").otherwise("vector").alias("rerank_source")))


@query("with " + _CON + """, o as (select r.source as query_id, r.source, a.description as source_desc, r.type as relation, r.target, b.description as target_desc,
  row_number() over w as ord, sum(length(to_json({'source': r.source, 'source_desc': a.description, 'relation': r.type, 'target': r.target, 'target_desc': b.description})) + 9) over w as used
  from rel r join con a on a.id = r.source join con b on b.id = r.target window w as (partition by r.source order by r.source, r.type, r.target))
select query_id, source, source_desc, relation, target, target_desc, ord::int as ord from o where ord <= 12 and used <= 4000
""")
def bounded_context(spark: SparkSession, d: str) -> DataFrame:
    con, rel = _graph(spark, d)
    return V.bounded_context(G._described(rel, con).withColumn("query_id", F.col("source")))


@query("with " + _CON + """, names as (select 'q' || (i % 3) as query_id, 'S' || i as name from range(9) r(i))
select distinct query_id, r.source, a.description as source_desc, r.type as relation, r.target, b.description as target_desc
from names join rel r on r.source = name or r.target = name join con a on a.id = r.source join con b on b.id = r.target where """ + _D2)
def teach_contexts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("string")
    names = spark.range(9).select(F.concat(F.lit("q"), (F.col("id") % 3).cast("string")).alias("query_id"), F.concat(F.lit("S"), i).alias("name"), F.lit("doc2").alias("scope"))
    return V.contexts(names, *_graph(spark, d), hops=1)


# The store


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), "source", "text", "doc_id")
    old = x.filter("doc_id % 3 > 0").select("parent_id", "source", T.content_hash(F.col("text")).alias("content_hash"))
    new = x.filter("doc_id % 11 > 0").select("parent_id", "source", T.content_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return old, new


@query("select doc_id::varchar as parent_id from documents where doc_id % 11 > 0 and (doc_id % 3 = 0 or doc_id % 7 = 0)")
def freshness_anti(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return K.not_fresh(new, old).select("parent_id")


@query("select doc_id::varchar as parent_id from documents where doc_id % 3 > 0 and doc_id % 11 = 0")
def stale_anti(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return K.stale(old, new).select("parent_id")


@query("""
select doc_id::varchar as parent_id, source, sha256(case when doc_id % 7 = 0 and doc_id % 11 > 0 then text || '!' else text end) as content_hash from documents where doc_id % 11 > 0 or doc_id % 3 > 0
""")
def keyed_replace(spark: SparkSession, d: str) -> DataFrame:
    return K.replace_parents(*_versions(spark, d))


@query("""
with e as (select p_brand as source, p_name as section, lower(p_name) as k, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as w from (select distinct p_brand, p_name from part)),
a as (select p_brand as source, p_type as title, lower(p_type) as ak, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) as aw from (select distinct p_brand, p_type from part)
  union all select p_brand, upper(p_name) || '.' , lower(p_name), list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) from (select distinct p_brand, p_name from part where p_partkey % 2 = 0)),
s as (select e.source, section, title, regexp_replace(k, '[^\\p{L}\\p{N}]+', '', 'g') as k, regexp_replace(ak, '[^\\p{L}\\p{N}]+', '', 'g') as ak, len(list_intersect(w, aw)) / len(w)::double as overlap from e join a on e.source = a.source),
r as (select *, (contains(ak, k) or contains(k, ak))::int as within, k = ak as same from s),
b as (select *, row_number() over (partition by source, section order by case when same then 1e9 else overlap + within end desc, case when same then title end, title desc) as nth from r where same or overlap >= 0.6 or within > 0)
select x.source, x.section, b.title from (select distinct source, section from e) x left join b on b.source = x.source and b.section = x.section and nth = 1
""")
def title_match(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    names = p.select(F.col("p_brand").alias("source"), F.col("p_name").alias("section")).distinct()
    titles = p.select(F.col("p_brand").alias("source"), F.col("p_type").alias("title")).distinct().union(p.filter("p_partkey % 2 = 0").select("p_brand", F.concat(F.upper("p_name"), F.lit("."))).distinct())
    return E.match_titles(names, titles)


# Text for display, and whole answers


@query()
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("| a | b |\n| "), F.left("text", F.lit(20)), F.lit(" | 1 |\nso \\(x\\) is\n\\[ y = "), F.col("doc_id").cast("string"), F.lit(" \\]\n"))
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(M.display_blocks_column(F.regexp_replace(text, "\n\n", " "))).alias("block_no", "b"))
    return rows.select("doc_id", "block_no", "b.kind", "b.body")


@query("""
select 'src' || (doc_id % 3) as source, '[' || source || ' — ' || doc_id || case when n_chars % 3 = 0 then '' when n_chars % 3 = 1 then ', p.4' else ', p.4–5' end || ']' as label from documents
""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_chars") % 3
    x = t(spark, d, "documents")
    pages = F.when(k > 0, 4), F.when(k == 1, 4).when(k == 2, 5).otherwise(7)
    return x.select(F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("source"), T.source_label(F.col("source"), F.col("doc_id").cast("string"), *pages).alias("label"))


@query("""
with h as (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc' || doc_id)) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h
""")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", T.uuid5(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("id"))


@query()
def ask_documents(spark: SparkSession, d: str) -> DataFrame:
    """Answers, from documents as sections, to all items of the benchmark, with the offline provider."""
    provider = OfflineProvider()
    embed = F.pandas_udf(lambda s: pd.Series(list(provider.embed(s.tolist()))), "array<float>")
    x = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), "source", F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("text").alias("page_content"), F.array(F.concat(F.lit("S"), (F.col("doc_id") % 50).cast("string"))).alias("anchor_nodes"))
    questions = x.select(F.col("parent_id").alias("id"), "parent_id", F.left("page_content", F.lit(120)).alias("question"), F.lit("").alias("key_knowledge"), "source", embed("page_content").alias("vector"))
    queries = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), embed("text").alias("vector"), F.lit("").alias("target_file"))
    return V.ask(queries, questions, x, *_graph(spark, d), provider)

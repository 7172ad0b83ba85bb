"""The engine's queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import vector
from .functions.properties import number, text
from .graph import Graph, Nodes
from .operators import conversations, dataset, events, lists, meta, navigation, reasoning, retrieval, storage
from .operators.adjacency import Adjacency
from .operators.state import shared_root
from .plans import catalog, verify
from .plans.executor import Executor
from .plans.plan import Plan, default_plan
from .sources import files
from .sources.tables import AS_OF, NODES, load, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The fixture conventions of sources.tables, in SQL.
def conf(key: str) -> str:
    return f"(0.5::double + ({key} % 50) / 100.0::double)"


def live(key: str) -> str:
    return f"({key} % 17 <> 0)"


def live_edge(key: str) -> str:
    return f"({key} % 23 <> 0)"


ASOF = "timestamp '2024-01-31'"


def stored_edges(spark, sf: str, g: Graph, relations: list[str]) -> Adjacency:
    """The tables' edges of these relations by endpoint, stored once in a session."""
    name = "edges_" + hashlib.md5("|".join([sf, *relations]).encode()).hexdigest()
    if spark.catalog.tableExists(f"{name}_back"):
        return Adjacency(spark, f"{name}_out", f"{name}_back")
    return Adjacency.store(g.edges, name, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 2 * spark.sparkContext.defaultParallelism)


def ids(nodes: Nodes) -> DataFrame:
    return nodes.df.select("id")


def with_conf(nodes: Nodes) -> DataFrame:
    return nodes.df.select("id", F.round("confidence", 4).alias("confidence"))


# Retrieval


@query(f"select 'customer:' || c_custkey as id, round({conf('c_custkey')}, 4) as confidence from customer where c_mktsegment = 'BUILDING' and {live('c_custkey')}")
def select_exact(spark, sf):
    return with_conf(retrieval.select_exact(load(spark, sf, ["CUSTOMER"]), "CUSTOMER", "c_mktsegment", "BUILDING"))


@query(f"select 'order:' || o_orderkey as id from orders where o_custkey = 7 and {live('o_orderkey')}")
def select_exact_number(spark, sf):
    return ids(retrieval.select_exact(load(spark, sf, ["ORDER"]), "ORDER", "o_custkey", 7))


@query("select 'customer:17' as id, true as deprecated from customer where c_custkey = 17")
def select_by_id(spark, sf):
    return retrieval.select_by_id(load(spark, sf, ["CUSTOMER"]), "customer:17").df.select("id", "deprecated")


@query(f"select 'event:' || event_id as id from events where event_type = 'click' and {live('event_id')} and ts >= {ASOF} - interval 14 day")
def select_fresh(spark, sf):
    return ids(retrieval.select_fresh(load(spark, sf, ["EVENT_LOG"]), "EVENT_LOG", "event_type", "click", timedelta(days=14), AS_OF))


@query(f"select 'part:' || p_partkey as id from part where {live('p_partkey')}")
def find_by_type(spark, sf):
    return ids(retrieval.find_by_type(load(spark, sf, ["PART", "SUPPLIER"]), "PART"))


# Every declared type: its table, its rows, the prefix of its ids and its key.
TYPES_SQL = [
    ("REGION", "region", "true", "region", "r_regionkey"), ("NATION", "nation", "true", "nation", "n_nationkey"), ("CUSTOMER", "customer", "true", "customer", "c_custkey"), ("SUPPLIER", "supplier", "true", "supplier", "s_suppkey"),
    ("PART", "part", "true", "part", "p_partkey"), ("ORDER", "orders", "true", "order", "o_orderkey"), ("DOC", "documents", "true", "doc", "doc_id"), ("VECTOR", "embeddings", "true", "vector", "vec_id"), ("PAGE", "pages", "true", "page", "page_id"),
    ("EVENT_LOG", "events", "true", "event", "event_id"), ("INTERRUPT_L1", "events", "event_type = 'error' and value > 100", "l1", "event_id"), ("INTERRUPT_L2", "events", "event_type <> 'error'", "l2", "event_id"),
    ("SESSION", "(select distinct conv_id from conversations)", "true", "session", "conv_id"),
]


@query(" union all ".join([f"select '{prefix}:' || {key} as id from {name} where {rows}" for _, name, rows, prefix, key in TYPES_SQL] + ["select 'turn:' || conv_id || ':' || turn from conversations"]))
def all_nodes(spark, sf):
    return ids(retrieval.all_nodes(load(spark, sf, list(NODES)), deprecated=True))


def first_vector(spark, sf):
    """The query vector of the similarity queries: the one with id 1, one row."""
    return table(spark, sf, "embeddings").where("vec_id = 1").select("embedding").first()["embedding"]


SCORED = "select vec_id, label, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)) as score from embeddings"


@query(f"with s as ({SCORED}), t as (select * from s order by score desc, 'vector:' || vec_id limit 30) select 'vector:' || vec_id as id, round(score, 4) as score from t where score >= 0.1 and {live('vec_id')} order by t.score desc, 'vector:' || vec_id limit 10")
def select_approx(spark, sf):
    g = load(spark, sf, ["VECTOR"])
    return retrieval.select_approx(g, F.array(*map(F.lit, first_vector(spark, sf))), 10, 0.1).df.select("id", F.round("score", 4).alias("score"))


@query(f"with s as ({SCORED}), t as (select * from s order by score desc, 'vector:' || vec_id limit 60) select 'vector:' || vec_id as id, round(score, 4) as score from t where score >= 0.0 and {live('vec_id')} order by t.score desc, 'vector:' || vec_id limit 20")
def select_approx_typed(spark, sf):
    g = load(spark, sf, ["VECTOR", "NATION"])
    return retrieval.select_approx(g, F.array(*map(F.lit, first_vector(spark, sf))), 20, 0.0, "VECTOR").df.select("id", F.round("score", 4).alias("score"))


@query(f"with s as ({SCORED}) select 'vector:' || vec_id as id, round(score, 4) as score from s order by s.score desc, 'vector:' || vec_id limit 25")
def ann_top_k(spark, sf):
    return retrieval.nearest(load(spark, sf, ["VECTOR"]), F.array(*map(F.lit, first_vector(spark, sf))), 25).select("id", F.round("score", 4).alias("score"))


@query("""with b as (select doc_id, list_transform(range(0, 384), lambda i: ('0x' || substr(sha256(text), ((i % 32) * 2 + 1)::int, 2))::int / 255.0::double * 2 - 1) as v from documents),
n as (select doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from b)
select doc_id, round((v[1] / norm)::float::double, 5) as first, round((v[384] / norm)::float::double, 5) as last, len(v)::int as dimensions from n""")
def hash_embedding(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", vector.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0].cast("double"), 5).alias("first"), F.round(F.col("v")[383].cast("double"), 5).alias("last"), F.size("v").alias("dimensions"))


# Navigation


@query(f"select 'nation:' || c_nationkey as id from customer where c_mktsegment = 'BUILDING' and {live('c_custkey')} and {live_edge('c_custkey')} and {live('c_nationkey')}")
def traverse_out(spark, sf):
    g = load(spark, sf, ["CUSTOMER", "NATION"], ["IN_NATION"])
    return ids(navigation.traverse(g, retrieval.select_exact(g, "CUSTOMER", "c_mktsegment", "BUILDING"), "IN_NATION"))


@query(f"select 'order:' || o_orderkey as id from orders where {live('o_orderkey')} and {live_edge('o_orderkey')} and {live('o_custkey')}")
def traverse_in(spark, sf):
    g = load(spark, sf, ["CUSTOMER", "ORDER"], ["PLACED_BY"])
    return ids(navigation.traverse(g, retrieval.find_by_type(g, "CUSTOMER"), "PLACED_BY", "in"))


@query(f"""with e as (select 'turn:' || conv_id || ':' || turn as s, 'turn:' || conv_id || ':' || (turn - 1) as t from conversations where turn > 0 and {live_edge('(conv_id + turn)')}),
n as (select 'turn:' || conv_id || ':' || turn as id, role from conversations where {live('(conv_id + turn)')}),
far as (select e.t as id from n join e on n.id = e.s where role = 'user' union all select e.s from n join e on n.id = e.t where role = 'user') select far.id from far join n using (id)""")
def traverse_both(spark, sf):
    g = load(spark, sf, ["CONVERSATION_TURN"], ["FOLLOWS"])
    return ids(navigation.traverse(g, retrieval.select_exact(g, "CONVERSATION_TURN", "role", "user"), "FOLLOWS", "both"))


@query(f"select 'part:' || l_partkey as id from lineitem where {live_edge('(l_orderkey + l_partkey)')} and {live('l_partkey')} and {live('l_orderkey')}")
def traverse_bag(spark, sf):
    g = load(spark, sf, ["ORDER", "PART"], ["HAS_PART"])
    return ids(navigation.traverse(g, retrieval.find_by_type(g, "ORDER"), "HAS_PART"))


@query(f"""with e as (select 'order:' || l_orderkey as s, 'part:' || l_partkey as t from lineitem where {live_edge('(l_orderkey + l_partkey)')}
union select 'part:' || l_partkey, 'supplier:' || l_suppkey from (select distinct l_partkey, l_suppkey from lineitem) where {live_edge('(l_partkey + l_suppkey)')}),
seed as (select 'order:' || o_orderkey as id from orders where o_custkey = 7 and {live('o_orderkey')}),
h1 as (select distinct t as id from e join seed on s = id), h2 as (select distinct t as id from e join h1 on s = id)
select id from (select id from h1 union select id from h2) where id in (select 'part:' || p_partkey from part where {live('p_partkey')} union all select 'supplier:' || s_suppkey from supplier where {live('s_suppkey')})""")
def expand_2hop(spark, sf):
    g = load(spark, sf, ["ORDER", "PART", "SUPPLIER"], ["HAS_PART", "SUPPLIED_BY"])
    g.adjacency = stored_edges(spark, sf, g, ["HAS_PART", "SUPPLIED_BY"])
    return ids(navigation.expand(g, retrieval.select_exact(g, "ORDER", "o_custkey", 7), max_hops=2))


@query(f"""with recursive e as (select conv_id, turn from conversations where turn > 0 and {live_edge('(conv_id + turn)')}),
w as (select conv_id, turn, 0 as d from conversations where turn = 5 union all select w.conv_id, w.turn - 1, d + 1 from w join e on e.conv_id = w.conv_id and e.turn = w.turn where d < 4)
select distinct 'turn:' || conv_id || ':' || turn as id from w where turn <> 5 and {live('(conv_id + turn)')}""")
def expand_through_deprecated(spark, sf):
    g = load(spark, sf, ["CONVERSATION_TURN"], ["FOLLOWS"])
    seeds = lists.filter_nodes(retrieval.find_by_type(g, "CONVERSATION_TURN", deprecated=True), "properties.turn_index == 5")
    return ids(navigation.expand(g, seeds, ["FOLLOWS"], 4))


@query(f"""with e as (select 'part:' || l_partkey as p, 'supplier:' || l_suppkey as s from (select distinct l_partkey, l_suppkey from lineitem) where {live_edge('(l_partkey + l_suppkey)')}),
o as (select distinct 'part:' || l_partkey as p from lineitem where l_orderkey = 1 and {live_edge('(l_orderkey + l_partkey)')})
select 'order:1>' || e.p || '>' || e.s || '>nation:' || s_nationkey as path from o join e using (p) join supplier on 'supplier:' || s_suppkey = e.s where {live_edge('s_suppkey')} and s_nationkey = (select min(s_nationkey) from o join e using (p) join supplier on 'supplier:' || s_suppkey = e.s where {live_edge('s_suppkey')})""")
def path_find(spark, sf):
    g = load(spark, sf, ["ORDER", "PART", "SUPPLIER", "NATION"], ["HAS_PART", "SUPPLIED_BY", "IN_NATION"])
    g.adjacency = stored_edges(spark, sf, g, ["HAS_PART", "SUPPLIED_BY", "IN_NATION"])
    parts = navigation.hops(g, ["HAS_PART"], "out", ["order:1"]).select(F.col("far").alias("p"))
    suppliers = navigation.hops(g, ["SUPPLIED_BY"], "out").join(F.broadcast(parts), F.col("near") == F.col("p")).select(F.col("far").alias("s"))
    nation = navigation.hops(g, ["IN_NATION"], "out").join(F.broadcast(suppliers.distinct()), F.col("near") == F.col("s")).agg(F.min(F.substring("far", 8, 9).cast("int")).alias("n")).first()["n"]  # of one order's parts
    return navigation.path_find(g, "order:1", f"nation:{nation}").select(F.array_join("path", ">").alias("path"))


SUBGRAPH = f"""with e as (select 'turn:' || conv_id || ':' || turn as source, 'turn:' || conv_id || ':' || (turn - 1) as target from conversations where turn > 0 and {live_edge('(conv_id + turn)')}
union all select 'turn:' || conv_id || ':' || turn, 'session:' || conv_id from conversations where {live_edge('(conv_id + turn)')}),
d0 as (select 'turn:3:3' as id), d1 as (select distinct target as id from e join d0 on source = id), d2 as (select distinct target as id from e join d1 on source = id),
n as (select 'turn:' || conv_id || ':' || turn as id from conversations union all select distinct 'session:' || conv_id from conversations)"""


@query(f"{SUBGRAPH} select id from n where id in (select id from d0 union select id from d1 union select id from d2)")
def subgraph_nodes(spark, sf):
    g = load(spark, sf, ["CONVERSATION_TURN", "SESSION"], ["FOLLOWS", "PART_OF"])
    return ids(navigation.subgraph(g, "turn:3:3")[0])


@query(f"{SUBGRAPH} select source, target from e where source in (select id from d0 union select id from d1)")
def subgraph_edges(spark, sf):
    g = load(spark, sf, ["CONVERSATION_TURN", "SESSION"], ["FOLLOWS", "PART_OF"])
    return navigation.subgraph(g, "turn:3:3")[1].select("source", "target")


@query(f"select 'supplier:' || l_suppkey as other from (select distinct l_partkey, l_suppkey from lineitem) where l_partkey = 5 and {live_edge('(l_partkey + l_suppkey)')}")
def edges_out(spark, sf):
    return navigation.edges_of(load(spark, sf, ["PART"], ["SUPPLIED_BY"]), "part:5").select(F.col("target").alias("other"))


@query(f"select 'part:' || l_partkey as other from (select distinct l_partkey, l_suppkey from lineitem) where l_suppkey = 3 and {live_edge('(l_partkey + l_suppkey)')}")
def edges_in(spark, sf):
    return navigation.edges_of(load(spark, sf, ["PART"], ["SUPPLIED_BY"]), "supplier:3", "target").select(F.col("source").alias("other"))


# One path for each last edge into the target: all of length 2 here, or longer by one where the turn before is reached too.
@query(f"""with e as (select conv_id, turn from conversations where turn > 0 and conv_id = 3 and {live_edge('(conv_id + turn)')}), p as (select conv_id, turn from conversations where conv_id = 3 and {live_edge('(conv_id + turn)')}),
recursive_free as (select 0 as d where exists (select 1 from p where turn = 6) union all select 1 where exists (select 1 from e where turn = 6) and exists (select 1 from p where turn = 5)
union all select 2 where exists (select 1 from e where turn = 6) and exists (select 1 from e where turn = 5) and exists (select 1 from p where turn = 4))
select case d when 0 then 'turn:3:6>session:3' when 1 then 'turn:3:6>turn:3:5>session:3' else 'turn:3:6>turn:3:5>turn:3:4>session:3' end as path from recursive_free r where d < 3 and not exists (select 1 from range(0, d) x(k) where k not in (select d from recursive_free) and exists (select 1 from recursive_free y where y.d < x.k))""")
def path_find_last_hop(spark, sf):
    """The paths of up to three edges from a turn to its session."""
    g = load(spark, sf, ["CONVERSATION_TURN", "SESSION"], ["FOLLOWS", "PART_OF"])
    return navigation.path_find(g, "turn:3:6", "session:3", max_hops=3, mode="last_hop").select(F.array_join("path", ">").alias("path"))


# Lists


def segments(g: Graph) -> tuple[Nodes, Nodes]:
    every = retrieval.find_by_type(g, "CUSTOMER")
    return lists.filter_nodes(every, "properties.c_nationkey < 10"), lists.filter_nodes(every, "properties.c_acctbal > 0")


A, B = "c_nationkey < 10", "c_acctbal > 0"
BOTH = f"select 'customer:' || c_custkey as id from customer where {live('c_custkey')} and "


@query(f"{BOTH} {A} and {B}")
def set_intersect(spark, sf):
    return ids(lists.intersect(*segments(load(spark, sf, ["CUSTOMER"]))))


@query(f"{BOTH} ({A} or {B})")
def set_union(spark, sf):
    return ids(lists.union(*segments(load(spark, sf, ["CUSTOMER"]))))


@query(f"{BOTH} {A} and not ({B})")
def set_difference(spark, sf):
    return ids(lists.difference(*segments(load(spark, sf, ["CUSTOMER"]))))


def filtered(spark, sf, text: str, types: list[str] = ("ORDER",)) -> DataFrame:
    return ids(lists.filter_nodes(retrieval.all_nodes(load(spark, sf, list(types))), text))


@query(f"select 'order:' || o_orderkey as id from orders where {live('o_orderkey')} and o_orderpriority = '1-URGENT'")
def filter_eq(spark, sf):
    return filtered(spark, sf, "properties.o_orderpriority == '1-URGENT'")


@query(f"select 'nation:' || n_nationkey as id from nation where {live('n_nationkey')} union all select 'customer:' || c_custkey from customer where {live('c_custkey')} and c_mktsegment <> 'BUILDING'")
def filter_ne_missing(spark, sf):
    return filtered(spark, sf, 'properties.c_mktsegment != "BUILDING"', ["NATION", "CUSTOMER"])


@query(f"select 'order:' || o_orderkey as id from orders where {live('o_orderkey')} and o_totalprice < 50000")
def filter_lt_mixed(spark, sf):
    return filtered(spark, sf, "properties.o_totalprice < 50000", ["ORDER", "NATION"])


@query(f"select 'order:' || o_orderkey as id from orders where {live('o_orderkey')} and {conf('o_orderkey')} >= 0.9")
def filter_confidence(spark, sf):
    return filtered(spark, sf, "confidence >= 0.9")


@query("select 'x' as id where false")
def filter_malformed(spark, sf):
    return filtered(spark, sf, "confidence >= 0.9 AND label == 'x'")


@query(f"select 'customer:' || c_custkey as id, round(c_acctbal * {conf('c_custkey')}, 4) as score from customer where {live('c_custkey')} order by c_acctbal * {conf('c_custkey')} desc, 'customer:' || c_custkey limit 50")
def rank_score(spark, sf):
    ranked = lists.rank(retrieval.find_by_type(load(spark, sf, ["CUSTOMER"]), "CUSTOMER"), F.expr("try_variant_get(parse_json(properties), '$.c_acctbal', 'double') * confidence"))
    return lists.top_k(ranked, 50).df.select("id", F.round("score", 4).alias("score"))


@query(f"select 'part:' || p_partkey as id from part where {live('p_partkey')} order by p_name desc, 'part:' || p_partkey limit 40")
def sort_desc(spark, sf):
    return ids(lists.top_k(lists.sort(retrieval.find_by_type(load(spark, sf, ["PART"]), "PART"), F.col("label"), True), 40))


@query(f"select 'part:' || p_partkey as id from part where {live('p_partkey')} order by 'part:' || p_partkey limit 10")
def top_k(spark, sf):
    return ids(lists.top_k(retrieval.find_by_type(load(spark, sf, ["PART"]), "PART")))


@query(f"select count(*) as n from lineitem where {live_edge('(l_orderkey + l_partkey)')} and {live('l_partkey')} and {live('l_orderkey')}")
def count_bag(spark, sf):
    g = load(spark, sf, ["ORDER", "PART"], ["HAS_PART"])
    return lists.count(navigation.traverse(g, retrieval.find_by_type(g, "ORDER"), "HAS_PART"))


def _aggregate(fn: str):
    @query(f"select round({fn}(o_totalprice)::double, 3) as value from orders where {live('o_orderkey')}")
    def run(spark, sf):
        return lists.aggregate(retrieval.find_by_type(load(spark, sf, ["ORDER"]), "ORDER"), fn, "o_totalprice").select(F.round("value", 3).alias("value"))

    del QUERIES["run"]
    QUERIES[f"agg_{fn}"], ORACLE_SQL[f"agg_{fn}"] = run, ORACLE_SQL.pop("run")


for _fn in ("sum", "avg", "min", "max", "count"):
    _aggregate(_fn)


@query("select 0.0::double as value")
def agg_empty_zero(spark, sf):
    return lists.aggregate(retrieval.find_by_type(load(spark, sf, ["ORDER"]), "ORDER"), "max", "o_orderpriority")


@query(f"select c_mktsegment as key, count(*) as n from customer where {live('c_custkey')} group by 1")
def group_key(spark, sf):
    return lists.group(retrieval.find_by_type(load(spark, sf, ["CUSTOMER"]), "CUSTOMER"), text(F.col("properties"), "c_mktsegment"))


@query(f"select c_mktsegment as key, 'customer:' || c_custkey as id from customer where {live('c_custkey')}")
def group_members(spark, sf):
    return lists.group_members(retrieval.find_by_type(load(spark, sf, ["CUSTOMER"]), "CUSTOMER"), text(F.col("properties"), "c_mktsegment")).df.select("key", "id")


@query(f"select 'order:' || o_orderkey as id, round({conf('o_orderkey')}, 4) as confidence from orders where {live('o_orderkey')} order by {conf('o_orderkey')} desc, 'order:' || o_orderkey limit 1")
def reduce_best(spark, sf):
    return with_conf(lists.reduce_best(retrieval.find_by_type(load(spark, sf, ["ORDER"]), "ORDER")))


@query("with t as (" + " union all ".join([f"select '{t}' as type_id, count(*) as n from {name} where {rows} and {live(key)}" for t, name, rows, _, key in TYPES_SQL] + [f"select 'CONVERSATION_TURN', count(*) from conversations where {live('(conv_id + turn)')}"]) + ") select * from t union all select 'total', sum(n)::bigint from t")
def type_stats(spark, sf):
    return lists.count_by_type(load(spark, sf, list(NODES)))


# Reasoning


@query(f"select 'orders of 7' as claim, round(min({conf('o_orderkey')}), 4) as confidence, count(*) as n_sources, null::varchar as unknown_reason from orders where o_custkey = 7 and {live('o_orderkey')}")
def assert_ok(spark, sf):
    g = load(spark, sf, ["ORDER"])
    row = reasoning.assert_claim(g, "orders of 7", ids(retrieval.select_exact(g, "ORDER", "o_custkey", 7)), 0.5)
    return row.select("claim", F.round("confidence", 4).alias("confidence"), "n_sources", "unknown_reason")


@query("select * from (values ('none', 'no_sources'), ('missing', 'source_missing'), ('deprecated', 'source_deprecated'), ('low', 'below_threshold: 0.51<0.70'), ('good', null)) t(claim, unknown_reason)")
def assert_unknown_reasons(spark, sf):
    g = load(spark, sf, ["CUSTOMER"])
    made = [("none", []), ("missing", ["customer:1", "customer:-1"]), ("deprecated", ["customer:17", "customer:1"]), ("low", ["customer:1", "customer:49"]), ("good", ["customer:49", "customer:48"])]
    rows = [reasoning.assert_claim(g, claim, spark.createDataFrame([(i,) for i in sources], "id string"), 0.7) for claim, sources in made]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("claim", "unknown_reason")


@query(f"select 'customer:' || c_custkey as source, 'nation:' || c_nationkey as via, 'region:' || n_regionkey as target, round(least({conf('c_custkey')}, {conf('n_nationkey')}) * 0.9::double, 4) as confidence from customer join nation on n_nationkey = c_nationkey where {live('c_custkey')} and {live_edge('c_custkey')} and {live_edge('n_nationkey')}")
def infer_transitive(spark, sf):
    g = load(spark, sf, ["CUSTOMER", "NATION", "REGION"], ["IN_NATION", "IN_REGION"])
    return reasoning.infer(g, "customer_region").select("source", "via", "target", F.round("confidence", 4).alias("confidence"))


@query("""with f as (select min(doc_id) as a, text from documents group by text having count(*) > 1), p as (select f.a, d.doc_id as b from f join documents d on d.text = f.text and d.doc_id <> f.a)
select 'doc:' || a as a, 'doc:' || b as b, 'differ_on:' || case when x.lang <> y.lang then 'lang' when x.n_chars <> y.n_chars then 'n_chars' when true then 'path' end as reason from p join documents x on x.doc_id = a join documents y on y.doc_id = b""")
def contradict_pairs(spark, sf):
    g = load(spark, sf, ["DOC"])
    d = table(spark, sf, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"))
    first = d.groupBy("h", "s").agg(F.min("doc_id").alias("a"))
    pairs = d.join(first, ["h", "s"]).where("doc_id <> a").select(F.format_string("doc:%d", "a").alias("a"), F.format_string("doc:%d", "doc_id").alias("b"))
    return reasoning.contradictions(pairs, g.nodes)


@query(f"""with s as ({SCORED}), t as (select * from s order by score desc, 'vector:' || vec_id limit 60), h as (select {conf('vec_id')} as c from t where score >= 0.1 and {live('vec_id')} order by t.score desc, 'vector:' || vec_id limit 20),
a as (select count(*) as matched, coalesce(avg(c), 0) as m from h) select case when matched = 0 then 'UNKNOWN' when least(1.0, matched / 20) * m >= 0.7 then 'COVERED' when least(1.0, matched / 20) * m >= 0.4 then 'PARTIAL' else 'SPARSE' end as verdict, round(least(1.0, matched / 20) * m, 4) as score, matched from a""")
def check_coverage(spark, sf):
    g = load(spark, sf, ["VECTOR"])
    return reasoning.check_coverage(g, F.array(*map(F.lit, first_vector(spark, sf))), 20, 0.1).select("verdict", F.round("score", 4).alias("score"), "matched")


# Meta


@query("select 'customer:1' as id, 'CUSTOMER' as type_id")
def meta_type(spark, sf):
    return meta.get_type(retrieval.find_by_type(load(spark, sf, ["CUSTOMER", "NATION"]), "CUSTOMER"))


@query(f"select 'nation:' || n_nationkey as id, false as ok from nation where {live('n_nationkey')} union all select 'region:' || r_regionkey, true from region where {live('r_regionkey')}")
def meta_check_type(spark, sf):
    return meta.check_type(retrieval.all_nodes(load(spark, sf, ["REGION", "NATION"])), "REGION")


@query("select 'prov:CUSTOMER' as provenance_id, 'customer:1' as node_id, 'db_query' as source_type, 'trusted' as trust_level")
def meta_provenance(spark, sf):
    g = load(spark, sf, ["CUSTOMER"])
    return meta.get_provenance(g, retrieval.find_by_type(g, "CUSTOMER")).select("provenance_id", "node_id", "source_type", "trust_level")


@query(f"select 'event:' || event_id as id, ts >= {ASOF} - interval 7 day as fresh from events union all select 'event:-1', false")
def meta_fresh(spark, sf):
    g = load(spark, sf, ["EVENT_LOG"])
    asked = g.nodes.select("id").union(spark.createDataFrame([("event:-1",)], "id string"))
    return meta.is_fresh(g, asked, timedelta(days=7), AS_OF)


@query("select 'part:' || p_partkey as id, p_partkey % 17 = 0 as deprecated from part")
def meta_deprecated(spark, sf):
    g = load(spark, sf, ["PART"])
    return meta.is_deprecated(g, g.nodes)


@query("select 'doc:' || d.doc_id as id, 'doc:' || o.doc_id as other from documents d left join documents o on o.text = d.text and o.doc_id <> d.doc_id")
def meta_contradictions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("s"))
    both = d.join(d.withColumnRenamed("doc_id", "o"), "s").where("o <> doc_id")
    u = both.groupBy("doc_id").agg(F.collect_list(F.format_string("doc:%d", "o")).alias("contradiction_set")).select(F.format_string("doc:%d", "doc_id").alias("node_id"), "contradiction_set")
    g = load(spark, sf, ["DOC"])
    g.uncertainty = u
    return meta.get_contradictions(g, g.nodes)


@query("select 'nation:' || n_nationkey as id, case when n_nationkey % 2 = 0 then 0.5::double end as confidence, case when n_nationkey % 2 = 0 then 1.0::double end as coverage, case when n_nationkey % 2 = 0 then n_nationkey / 100.0::double end as freshness_score from nation")
def meta_confidence(spark, sf):
    g = load(spark, sf, ["NATION"])
    g.uncertainty = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.format_string("nation:%d", "n_nationkey").alias("node_id"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("coverage"), (F.col("n_nationkey") / 100).alias("freshness_score"))
    return meta.get_confidence(g, g.nodes)


# Storage


@query("select 'customer:' || c_custkey as id from customer where c_custkey % 9 = 0 or c_custkey % 6 = 0")
def insert_conflicts(spark, sf):
    """The keys that an insert would repeat: those that are there, and those that it has twice."""
    g, key = load(spark, sf, ["CUSTOMER"]), F.substr(F.col("id"), F.lit(10)).cast("long")
    new = g.nodes.where(key % 3 == 0).unionByName(g.nodes.where(key % 9 == 0))
    return storage.duplicates(g.nodes.where(key % 2 == 0), new)


@query("select sha256(html) as hash, octet_length(encode(html))::int as size from pages where page_id = 7")
def content_lookup(spark, sf):
    pages = table(spark, sf, "pages").select(F.format_string("page:%d", "page_id").alias("id"), F.encode("html", "UTF-8").alias("data"), F.sha2("html", 256).alias("hash"))
    return storage.find(pages, "page:7").select("hash", F.length("data").alias("size"))


# Files


def project(spark, sf) -> DataFrame:
    """A directory tree as files.read_files gives it: a Python file for each part, which imports its neighbours, a
    document for each nation, a settings file for each region."""
    p, n, r = (table(spark, sf, t) for t in ("part", "nation", "region"))
    p = spread(p.select("p_partkey"), "p_partkey")
    key = F.col("p_partkey") + 1
    code = F.concat(F.lit("import pkg.m"), key - 1, F.lit("\nfrom m"), key + 1, F.lit(" import f\n\ndef f"), key, F.lit("():\n    def inner(): pass\n\nasync def g"), key, F.lit("(): pass\n"))
    made = [
        p.select(F.concat(F.lit("pkg/m"), key, F.lit(".py")).alias("path"), code.alias("text"), F.lit("CODE_FILE").alias("type_id"), F.lit("code").alias("format"), F.lit("python").alias("language")),
        n.select(F.concat(F.lit("docs/n"), "n_nationkey", F.lit(".md")).alias("path"), F.col("n_name").alias("text"), F.lit("DOC").alias("type_id"), F.lit("text").alias("format"), F.lit(None).cast("string").alias("language")),
        r.select(F.concat(F.lit("conf/r"), "r_regionkey", F.lit(".json")).alias("path"), F.lit("{}").alias("text"), F.lit("CONFIG").alias("type_id"), F.lit("json").alias("format"), F.lit(None).cast("string").alias("language")),
    ]
    rows = made[0].unionByName(made[1]).unionByName(made[2])
    return rows.select("path", F.encode("text", "UTF-8").alias("content"), "type_id", "format", "language", F.lit(AS_OF).cast("timestamp_ntz").alias("modified"))


CODE_SQL = "'import pkg.m' || (p - 1) || chr(10) || 'from m' || (p + 1) || ' import f' || chr(10) || chr(10) || 'def f' || p || '():' || chr(10) || '    def inner(): pass' || chr(10) || chr(10) || 'async def g' || p || '(): pass' || chr(10)"


@query(f"select 'pkg/m' || p || '.py' as source_uri, 'code' as format, sha256({CODE_SQL}) as hash from (select p_partkey + 1 as p from part) union all select 'docs/n' || n_nationkey || '.md', 'text', sha256(n_name) from nation union all select 'conf/r' || r_regionkey || '.json', 'json', sha256('{{}}') from region")
def file_contents(spark, sf):
    return files.contents(project(spark, sf)).select("source_uri", "format", "hash")


@query("""select 'file:pkg/m' || p || '.py' as id, 'CODE_FILE' as type_id, 'm' || p as name, 8.0::double as line_count, 0.9::double as confidence from (select p_partkey + 1 as p from part)
union all select 'file:docs/n' || n_nationkey || '.md', 'DOC', 'n' || n_nationkey, null, 0.9 from nation union all select 'file:conf/r' || r_regionkey || '.json', 'CONFIG', 'r' || r_regionkey, null, 0.9 from region""")
def file_nodes(spark, sf):
    p = F.col("properties")
    return files.file_nodes(project(spark, sf)).select("id", "type_id", F.coalesce(text(p, "module"), text(p, "title"), text(p, "key")).alias("name"), number(p, "line_count").alias("line_count"), "confidence")


@query("select 'pkg/m' || p || '.py' as path, kind, case kind when 'f' then 'f' || p when 'g' then 'g' || p else 'inner' end as label, 0.85::double as confidence from (select p_partkey + 1 as p from part), (values ('f'), ('g'), ('i')) k(kind)")
def python_functions(spark, sf):
    nodes = files.function_nodes(files.python_symbols(project(spark, sf)))
    return nodes.select(F.replace("provenance_id", F.lit("file:"), F.lit("")).alias("path"), F.substring("label", 1, 1).alias("kind"), "label", "confidence")


@query("select 'file:pkg/m' || p || '.py' as source, count(*) * 3 as n, 0.95::double as confidence from (select p_partkey + 1 as p from part) group by p")
def python_defines(spark, sf):
    return files.defines(files.python_symbols(project(spark, sf))).groupBy("source").agg(F.count("*").alias("n"), F.first("confidence").alias("confidence"))


@query("""select 'file:pkg/m' || p || '.py' as source, 'file:pkg/m' || (p - 1) || '.py' as target, 0.9::double as confidence from (select p_partkey + 1 as p from part) where p - 1 in (select p_partkey + 1 from part)
union all select 'file:pkg/m' || p || '.py', 'file:pkg/m' || (p + 1) || '.py', 0.9 from (select p_partkey + 1 as p from part) where p + 1 in (select p_partkey + 1 from part)""")
def python_imports(spark, sf):
    """Half of them by the exact path, half by its ending."""
    found = project(spark, sf)
    return files.imports(files.python_symbols(found), found).select("source", "target", "confidence")


@query("select 'customer:' || c_custkey as id, case when c_custkey % 3 = 0 then 2 else 1 end::int as version, (c_custkey % 17 = 0 or c_custkey % 5 = 0) as deprecated from customer")
def latest_version(spark, sf):
    g = load(spark, sf, ["CUSTOMER"])
    key = F.substring("id", 10, 20).cast("long")
    changed = storage.update_nodes(g.nodes, g.nodes.where(key % 3 == 0).select("id", F.lit(0.1).alias("confidence")), AS_OF)
    rows = g.nodes.unionByName(changed)
    gone = storage.deprecate(storage.latest(rows), g.nodes.where(key % 5 == 0))
    return storage.latest(rows.unionByName(gone)).select("id", "version", "deprecated")


@query("select user_id, max(ts) as last_verified, count(*) as n from events group by 1")
def latest_uncertainty(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("node_id"), F.col("ts").alias("last_verified"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    return storage.latest_uncertainty(rows).select(F.col("node_id").alias("user_id"), "last_verified", "n")


# Similarity links


@query("""with p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on b.vec_id < a.vec_id),
r as (select *, row_number() over (partition by a order by s desc, 'vector:' || b) as k from p where s >= 0.3) select 'vector:' || a as source, 'vector:' || b as target, round(s, 4) as weight from r where k <= 5""")
def similar_links(spark, sf):
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("vector:"), F.col("vec_id").cast("string")).alias("id"), F.col("vec_id").alias("seq"), "embedding")
    return files.links(v, 5, 0.3).select("source", "target", "weight")


# Conversations


def said(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), "role", "text")


@query("select 'turn:' || conv_id || ':' || turn as id, 'turn:' || conv_id || ':' || (turn - 1) as previous from conversations where turn > 0")
def turns_follow(spark, sf):
    return conversations.follows(said(spark, sf))


@query("select distinct conv_id::varchar as session_id from conversations where conv_id % 2 = 1")
def turns_part_of(spark, sf):
    turns = said(spark, sf)
    return conversations.sessions(turns.where("cast(session_id as long) % 2 = 0").select("session_id").distinct(), turns)


@query("select conv_id::varchar as session_id, turn as turn_index, role from conversations where turn % 2 = 1")
def turn_dedup(spark, sf):
    turns = said(spark, sf)
    return conversations.new_turns(turns.where("turn_index % 2 = 0"), turns.union(turns)).select("session_id", "turn_index", "role")


@query("select 'turn:' || conv_id || ':' || turn as id, len(regexp_split_to_array(trim(text), '\\s+'))::int as token_count from conversations")
def turn_token_count(spark, sf):
    return said(spark, sf).select("id", conversations.token_count(F.col("text")).alias("token_count"))


@query("select conv_id::varchar as session_id, max(turn) over (partition by conv_id) + 1 + turn as turn_index, role from conversations")
def turn_assignment(spark, sf):
    turns = said(spark, sf)
    return conversations.assign_turns(turns, turns.withColumn("seq", F.col("turn_index")).drop("turn_index")).select("session_id", "turn_index", "role")


@query(f"select 'turn:' || conv_id || ':' || turn as id from conversations where {live('(conv_id + turn)')} qualify row_number() over (partition by conv_id order by turn desc) <= 6")
def recent_turns(spark, sf):
    return conversations.recent_turns(conversations.turns_of(load(spark, sf, ["CONVERSATION_TURN"]))).select("id")


def opening(spark, sf):
    """The embedding of what session 1 opened with."""
    asked = said(spark, sf).where("session_id = '1' and turn_index = 0").select("role", "text").first()
    return vector.turn_embedding(F.lit(asked["role"]), F.lit(asked["text"]))


def sql_vector(text: str) -> str:
    return f"list_transform(range(0, 32), lambda i: ('0x' || substr(sha256({text}), (i * 2 + 1)::int, 2))::int / 255.0::double * 2 - 1)"


SEMANTIC = f"""t as (select *, {ASOF} + to_seconds(conv_id * 1000 + turn) as said_at, 'turn:' || conv_id || ':' || turn as id from conversations),
v as (select *, {sql_vector("'CONVERSATION_TURN ' || role || ': ' || substr(text, 1, 800)")} as v from t),
top as (select *, list_cosine_similarity(v, (select v from v where conv_id = 1 and turn = 0)) as score from v order by score desc, id limit 24),
hit as (select * from top where score >= 0.55 and {live('(conv_id + turn)')} and conv_id <> 3 order by score desc, id limit 4)"""


@query(f"with {SEMANTIC} select id, round(score, 4) as score from hit")
def semantic_turns(spark, sf):
    return conversations.semantic_turns(load(spark, sf, ["CONVERSATION_TURN"]), opening(spark, sf), "3").select("id", F.round("score", 4).alias("score"))


@query(f"""with {SEMANTIC},
r as (select * from t where conv_id = 3 and {live('(conv_id + turn)')} order by turn desc limit 6),
b as (select 'recent' as section, id, '' as session, turn, role, said_at, trim(text) as text from r union all select 'semantic', id, 'session:' || substr(conv_id::varchar, 1, 8) || ' | ', turn, role, said_at, trim(text) from hit)
select section, id, '[turn ' || turn || ' | ' || role || ' | ' || session || strftime(said_at, '%Y-%m-%d %H:%M:%S') || ']' || chr(10) || case when length(text) > 600 then substr(text, 1, 600) || '…' else text end as block from b
union all select 'total', '', count(*)::varchar from conversations""")
def context_block(spark, sf):
    """The query is what session 1 opened with."""
    return conversations.context_block(load(spark, sf, ["CONVERSATION_TURN"]), opening(spark, sf), "3")


@query(f"""with v as (select 'turn:' || conv_id || ':' || turn as id, conv_id, turn, {sql_vector('substr(text, 1, 1000)')} as v from conversations),
p as (select q.id, 'note:' || n.conv_id || ':' || n.turn as target, n.turn % 10 as kind, list_cosine_similarity(q.v, n.v) as s from v q join v n on n.turn % 5 = 0 where q.turn < 2),
top as (select * from p where s >= 0.5 qualify row_number() over (partition by id order by s desc, target) <= 20)
select id, target from top where kind = 0 qualify row_number() over (partition by id order by s desc, target) <= 5""")
def references(spark, sf):
    """What the first two turns of every session refer to among notes that repeat what was said; half of these are inferred."""
    c = table(spark, sf, "conversations")
    notes = c.where("turn % 5 = 0").select(F.concat_ws(":", F.lit("note"), "conv_id", "turn").alias("id"), F.when(F.col("turn") % 10 == 0, "DOC").otherwise("INFERRED").alias("type_id"), F.lit(False).alias("deprecated"), vector.hash_embedding(F.substring("text", 1, 1000)).alias("embedding"))
    return conversations.references_of(notes, said(spark, sf).where("turn_index < 2").select("id", "text"))


@query("""with c as (select 'checkpoint:' || event_id as id, ts, 'summary of ' || user_id as summary from events where event_type = 'click' and ts >= (select max(ts) from events where event_type = 'click') + interval 1 second - interval 600 second)
select id, ts as created_at, summary from c order by ts desc, id limit 1""")
def latest_checkpoint(spark, sf):
    e = table(spark, sf, "events")
    g = load(spark, sf, ["NATION"])
    fields = {"session_id": F.col("user_id").cast("string"), "summary": F.concat(F.lit("summary of "), F.col("user_id"))}
    g.nodes = events.record(e.where("event_type = 'click'"), "CHECKPOINT", fields, F.concat(F.lit("checkpoint:"), F.col("event_id").cast("string")), F.col("ts").cast("timestamp_ntz"))
    return conversations.latest_checkpoint(g, e.where("event_type = 'click'").agg(F.max("ts")).first()[0] + timedelta(seconds=1))


@query(f"""with l as (select conv_id, turn, '[' || role || '] ' || substr(text, 1, 800) as x from conversations where {live('(conv_id + turn)')} qualify row_number() over (partition by conv_id order by turn desc) <= 40)
select conv_id::varchar as session_id, substr(string_agg(x, chr(10) || '---' || chr(10) order by turn), 1, 4000) as summary from l group by 1""")
def checkpoint_summary(spark, sf):
    return conversations.checkpoint(conversations.turns_of(load(spark, sf, ["CONVERSATION_TURN"])))


@query("select floor(arg_max(value, ts) filter (where value > 0) * 100 / 200)::bigint as percent from events")
def context_usage(spark, sf):
    return conversations.context_usage(table(spark, sf, "events").select(F.col("ts").alias("seq"), F.col("value").alias("total")), 200)


# Events


@query("select 'event:' || event_id as id, ts as created_at from events order by ts desc limit 50")
def recent_events(spark, sf):
    return events.recent_events(load(spark, sf, ["EVENT_LOG"]), "EVENT_LOG").select("id", "created_at")


@query("""with i as (select 'l1:' || event_id as id, 1 as level, ts, event_id, value from events where event_type = 'error' and value > 100 union all select 'l2:' || event_id, 2, ts, event_id, value from events where event_type <> 'error'),
n as (select * from i order by ts desc limit 100) select id from n where not (level = 1 and event_id % 2 = 0) and not (level = 2 and least(1.0, value / 200) < 0.5)""")
def active_interrupts(spark, sf):
    return events.active_interrupts(load(spark, sf, ["INTERRUPT_L1", "INTERRUPT_L2"])).select("id")


@query(f"select event_type as pattern, count(*) as n from events where event_type <> 'error' and ts >= {ASOF} - interval 240 hour group by 1")
def pattern_frequency(spark, sf):
    return events.pattern_frequency(load(spark, sf, ["INTERRUPT_L2"]), AS_OF, 240)


@query(f"""with p as (select event_type, count(*) as n from events where event_type <> 'error' and ts >= {ASOF} - interval 240 hour group by 1 order by n desc, event_type limit 1)
select count(*) filter (where ts >= {ASOF} - interval 240 hour) as events, count(*) filter (where event_type <> 'error' or value > 100) as interrupts, coalesce((select event_type from p), 'none') as top_pattern, coalesce((select n from p), 0) as top_count from events""")
def event_summary(spark, sf):
    return events.event_summary(load(spark, sf, ["EVENT_LOG", "INTERRUPT_L1", "INTERRUPT_L2"]), AS_OF, 240)


@query("select 'challenge:' || event_id as id, round(least(1.0, value / 200), 6) as confidence, 'challenge:' || event_id || '>event:' || event_id as challenged, 'resolved' as ecl_status, value as arc_confidence, event_id % 2 = 0 as seen, 2::int as version from events where event_type = 'error' and value > 100")
def write_challenges(spark, sf):
    """Challenges with their edges, then their status changed: the other properties keep their kinds."""
    e = table(spark, sf, "events").where("event_type = 'error' and value > 100")
    key, at = F.concat(F.lit("challenge:"), F.col("event_id").cast("string")), F.col("ts")
    target = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    fields = {"target_node_id": target, "arc_confidence": F.col("value"), "seen": F.col("event_id") % 2 == 0, "ecl_status": F.lit("pending")}
    nodes = events.record(e, "ARC_CHALLENGE", fields, key, at, F.least(F.lit(1.0), F.col("value") / 200))
    edges = events.relation(e, key, target, "CHALLENGED_BY", at)
    changed = events.set_property(nodes, "ecl_status", F.lit("resolved"), AS_OF).join(edges.select(F.col("source").alias("id"), F.concat_ws(">", "source", "target").alias("challenged")), "id")
    p = F.col("properties")
    return changed.select("id", F.round("confidence", 6).alias("confidence"), "challenged", text(p, "ecl_status").alias("ecl_status"), number(p, "arc_confidence").alias("arc_confidence"), F.try_variant_get(F.parse_json(p), "$.seen", "boolean").alias("seen"), "version")


@query("""select 'l1' as level, 'l1:' || event_id || '>INTERRUPT_OF>event:' || event_id as edge, value as trigger_value, null::varchar as pattern, ts as created_at from events where event_type = 'error'
union all select 'l2', 'l2:' || event_id || '>INTERRUPT_OF>event:' || event_id, null, event_type, ts from events where event_type <> 'error'
union all select 'l3', null, null, null, ts from events where value > 100""")
def write_events(spark, sf):
    """Interrupts of all levels; those of the first two name the event that they interrupt."""
    e = table(spark, sf, "events")
    key = lambda level: F.concat(F.lit(f"{level}:"), F.col("event_id").cast("string"))
    made = {
        "l1": (e.where("event_type = 'error'"), "INTERRUPT_L1", {"trigger_metric": F.lit("value"), "trigger_value": F.col("value"), "threshold": F.lit(0.0), "action": F.lit("page"), "resolved": F.lit(False)}),
        "l2": (e.where("event_type <> 'error'"), "INTERRUPT_L2", {"pattern": F.col("event_type"), "salience_score": F.least(F.lit(1.0), F.col("value") / 200), "action": F.lit("note")}),
        "l3": (e.where("value > 100"), "INTERRUPT_L3", {"monitor": F.lit("value"), "observation": F.lit("high"), "action": F.lit("note"), "arc_triggered": F.lit(False)}),
    }
    out = []
    for level, (rows, type_id, fields) in made.items():
        nodes = events.record(rows, type_id, fields, key(level), F.col("ts"))
        target = F.lit(None).cast("string") if level == "l3" else F.concat(F.lit("event:"), F.col("event_id").cast("string"))
        edges = events.relation(rows, key(level), target, "INTERRUPT_OF", F.col("ts"))
        joined = nodes.join(edges.select(F.col("source").alias("id"), F.concat_ws(">", "source", "type_id", "target").alias("edge")), "id", "left")
        p = F.col("properties")
        out.append(joined.select(F.lit(level).alias("level"), "edge", number(p, "trigger_value").alias("trigger_value"), text(p, "pattern").alias("pattern"), "created_at"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("select 'outcome:' || event_id as id, event_type as outcome, 'user:' || user_id as challenger_id, round(value, 6) as risk_score from events order by ts desc, 'outcome:' || event_id limit 20")
def recent_decisions(spark, sf):
    e = table(spark, sf, "events")
    fields = {"outcome": F.col("event_type"), "challenger_id": F.concat(F.lit("user:"), F.col("user_id").cast("string")), "risk_score": F.col("value"), "reason": F.lit("r")}
    g = load(spark, sf, ["NATION"])
    g.nodes = g.nodes.unionByName(events.record(e, "ARBITRATION_OUTCOME", fields, F.concat(F.lit("outcome:"), F.col("event_id").cast("string")), F.col("ts").cast("timestamp_ntz")))
    return events.recent_decisions(g).select("id", "outcome", "challenger_id", F.round("risk_score", 6).alias("risk_score"))


# Plans

FLAGSHIP = {
    "steps": [
        {"step_id": "s1", "op": "SELECT_EXACT", "args": {"type": "CUSTOMER", "property": "c_mktsegment", "value": "BUILDING"}, "output_binding": "$customers"},
        {"step_id": "s2", "op": "FILTER", "args": {"input": "$customers", "condition": "properties.c_acctbal > 5000"}, "output_binding": "$rich", "depends_on": ["s1"]},
        {"step_id": "s3", "op": "TRAVERSE", "args": {"node": "$rich", "rel": "IN_NATION"}, "output_binding": "$nations", "depends_on": ["s2"]},
        {"step_id": "s4", "op": "TRAVERSE", "args": {"node": "$nations", "rel": "IN_REGION"}, "output_binding": "$regions", "depends_on": ["s3"]},
        {"step_id": "s5", "op": "ASSERT", "args": {"claim": "regions of rich builders", "sources": "$regions", "confidence_threshold": 0.5}, "output_binding": "$claim", "depends_on": ["s4"]},
    ],
    "synthesis": {"inputs": ["$claim"]},
    "constraints": {"timeout_ms": 600_000},
}


def flagship(spark, sf):
    g = load(spark, sf, ["CUSTOMER", "NATION", "REGION"], ["IN_NATION", "IN_REGION"])
    return g, Executor(g, AS_OF).run(Plan.from_dict(FLAGSHIP))


RICH = f"""select n_regionkey, c_custkey, c_nationkey from customer join nation on n_nationkey = c_nationkey where c_mktsegment = 'BUILDING' and c_acctbal > 5000 and {live('c_custkey')} and {live_edge('c_custkey')} and {live('c_nationkey')}"""


@query(f"select 'region:' || n_regionkey as id, count(*) as n from ({RICH}) where {live_edge('c_nationkey')} and {live('n_regionkey')} group by 1")
def plan_end_to_end(spark, sf):
    _, result = flagship(spark, sf)
    return result.bindings["$regions"].df.groupBy("id").agg(F.count("*").alias("n"))


@query(f"""with s1 as (select c_custkey, c_nationkey, c_acctbal from customer where c_mktsegment = 'BUILDING' and {live('c_custkey')}), s2 as (select * from s1 where c_acctbal > 5000),
s3 as (select c_nationkey from s2 where {live_edge('c_custkey')} and {live('c_nationkey')}), s4 as (select n_regionkey from s3 join nation on n_nationkey = c_nationkey where {live_edge('c_nationkey')} and {live('n_regionkey')}),
b as (select {conf('c_custkey')} as c from s1 union all select {conf('c_custkey')} from s2 union all select {conf('c_nationkey')} from s3 union all select {conf('n_regionkey')} from s4)
select true as completeness, true as provenance_ok, true as freshness_ok, round((sum(c) + 1) / (count(*) + 1), 6) as confidence from b""")
def verify_report(spark, sf):
    g, result = flagship(spark, sf)
    return verify.verify(g, result, AS_OF).select("completeness", "provenance_ok", "freshness_ok", F.round("confidence", 6).alias("confidence"))


@query("select 'supplier:' || s_suppkey || '>IN_NATION>nation:' || s_nationkey as id, 'SUPPLIER' as source_type, 'IN_NATION' as relation, 'NATION' as target_type from supplier")
def schema_violations(spark, sf):
    return verify.relation_violations(load(spark, sf, ["CUSTOMER", "SUPPLIER", "NATION"], ["IN_NATION"]))


@query("select 'customer:' || c_custkey as id, 'bad_enum:c_mktsegment=' || c_mktsegment as error from customer where c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')")
def node_violations(spark, sf):
    g = load(spark, sf, ["CUSTOMER", "NATION"])
    return verify.node_violations(g.nodes, g.schema)


def lines_of(spark, rows: dict[str, object]) -> DataFrame:
    """What the driver-side parts of the plan language say, a row (what, says) each."""
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "what string, says string")


def said_sql(rows: dict[str, str]) -> str:
    return "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") t(what, says)"


def plans_of(rows: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """A plan's text for each row, `#` standing for its key."""
    return rows.select(key, F.replace(F.get(F.array(*map(F.lit, texts)), F.col(key) % len(texts)), F.lit("#"), F.col(key).cast("string")).alias("text"))


def plan_text(*specs, synthesis: list[str] = []) -> str:  # noqa: B006
    made = [{"step_id": i, "op": op, "args": args, "output_binding": b, "depends_on": list(d)} for i, op, args, b, *d in specs]
    return json.dumps({"steps": made, "synthesis": {"inputs": synthesis}})


CLAIM, ANY = ("z#", "ASSERT", {"claim": "c", "sources": "$a"}, "$z"), ("a#", "SELECT_BY_ID", {"id": "x"}, "$a")
# Plans and what is wrong with them.
FAULTY = {
    plan_text(ANY, CLAIM): "", plan_text(ANY): "missing_terminal_assert", plan_text(("a#", "JOIN", {}, "$a")): "unknown_op:JOIN@a#, missing_terminal_assert", plan_text(ANY, ANY, CLAIM): "duplicate_step_id:a#",
    plan_text(("a#", "SELECT_BY_ID", {"id": "x"}, "a"), CLAIM, synthesis=["$z", "$y"]): "binding_must_start_with_$:a#, synthesis_input_not_bound:$y", plan_text((*ANY, "b#", "a#"), ("b#", *ANY[1:]), CLAIM): "forward_dependency:a#->b#",
    plan_text(("a#", "SELECT_EXACT", {"type": "MOON"}, "$a"), CLAIM): "unknown_type_in_select:MOON@a#", plan_text(("a#", "TRAVERSE", {"node": "$a"}, "$a"), CLAIM): "traverse_missing_rel:a#",
}


def one_of(values, key: str) -> str:
    """In SQL: the text that stands for a key."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"replace(list_extract([{listed}], ({key} % {len(values)})::int + 1), '#', {key}::varchar)"


@query(f"select c_custkey, {one_of(FAULTY.values(), 'c_custkey')} as problems from customer")
def plan_validation(spark, sf):
    """A plan for each customer, checked."""
    plans = catalog.parsed(plans_of(table(spark, sf, "customer"), "c_custkey", list(FAULTY)))
    return catalog.problems(plans, load(spark, sf, ["NATION"]).schema).select("c_custkey", F.array_join("problems", ", ").alias("problems"))


N = lambda i, *d: (i, "COUNT", {}, f"${i}", *d)
# Plans and the order of their steps.
ORDERS = {plan_text(N("a#"), N("b#")): "a# b#", plan_text(N("a#", "b#"), N("b#", "c#"), N("c#")): "c# b# a#", plan_text(N("a#", "x")): "a#", plan_text(N("a#", "c#"), N("b#"), N("c#")): "b# c# a#", plan_text(N("d#"), N("a#", "b#"), N("b#", "a#")): "d# !a#"}


@query(f"select o_orderkey, {one_of(ORDERS.values(), 'o_orderkey')} as steps from orders")
def plan_order(spark, sf):
    """A plan for each order: its steps in the order they run, and the first of a circle."""
    plans = catalog.in_order(catalog.parsed(plans_of(table(spark, sf, "orders"), "o_orderkey", list(ORDERS))))
    return plans.select("o_orderkey", F.concat_ws(" ", F.array_join("order", " "), F.concat(F.lit("!"), F.col("circular"))).alias("steps"))


STUB = json.dumps({"steps": [{"step_id": s.step_id, "op": s.op, "output_binding": s.output_binding} for s in default_plan("what is there?").steps], "constraints": {"timeout_ms": 700}})
SAID = [f"Sure:\n```json\n{STUB}\n```\nDone, #.", STUB.replace("700", "7#"), "no plan", "{broken", "} {"]


@query("""select p_partkey, case when p_partkey % 5 < 2 then 's1 SELECT_APPROX $hits, s2 ASSERT $claim' end as steps, case p_partkey % 5 when 0 then 700 when 1 then ('7' || p_partkey)::bigint end as timeout_ms from part""")
def plan_extraction(spark, sf):
    """The offline planner's plan in prose and code fences, and texts without one, for each part."""
    plans = catalog.parsed(plans_of(table(spark, sf, "part"), "p_partkey", SAID))
    steps = F.array_join(F.transform("plan.steps", lambda s: F.concat_ws(" ", s["step_id"], s["op"], s["output_binding"])), ", ")
    return plans.select("p_partkey", steps.alias("steps"), F.col("plan.constraints.timeout_ms").alias("timeout_ms"))


# Emptiness by policy, what coercion takes, the trace.
@query(said_sql({"halts": "PARTIAL s1=empty", "goes on": "COMPLETE s1=ok s2=ok", "error": "FAILED s1=error: op_not_implemented:NOPE", "count isn''t empty": "COMPLETE s1=ok s2=ok", "unknown": "PARTIAL s1=ok s2=no_sources"}))
def plan_statuses(spark, sf):
    g = load(spark, sf, ["NATION"])
    none = {"step_id": "s1", "op": "SELECT_EXACT", "args": {"type": "NATION", "property": "n_name", "value": "nowhere"}, "output_binding": "$a"}
    count = {"step_id": "s2", "op": "COUNT", "args": {"input": "$a"}, "output_binding": "$b", "depends_on": ["s1"]}
    claim = {"step_id": "s2", "op": "ASSERT", "args": {"claim": "c", "sources": "$a"}, "output_binding": "$b", "depends_on": ["s1"]}
    plans = {"halts": [none, count], "goes on": [none | {"on_empty": "CONTINUE"}, count], "error": [none | {"op": "NOPE"}, count], "count isn't empty": [none | {"on_empty": "CONTINUE"}, count], "unknown": [none | {"on_empty": "CONTINUE"}, claim]}

    def told(steps):
        r = Executor(g, AS_OF).run(Plan.from_dict({"steps": steps, "constraints": {"timeout_ms": 600_000}}))
        return " ".join([r.status, *(f"{t['step_id']}={'ok' if t['summary'] == 'empty' and s.get('on_empty') else t['summary']}" for s, t in zip(steps, r.trace))])

    return lines_of(spark, {k: told(v) for k, v in plans.items()})


@query(f"""select 'answer' as what, '[A1] Claim: nations of region 0' || chr(10) || '      Sources: ' || (select string_agg(s, ', ' order by k) from (select 'NATION:' || n_name as s, 'nation:' || n_nationkey as k from nation where n_regionkey = 0 and {live('n_nationkey')} order by k limit 5)) || chr(10) || '      Confidence: ' || printf('%.2f', (select min({conf('n_nationkey')}) from nation where n_regionkey = 0 and {live('n_nationkey')})) as says
union all select 'nothing', '[UNKNOWN: no_assertions_for_query: q]'""")
def synthesis_text(spark, sf):
    g = load(spark, sf, ["NATION"])
    steps = [{"step_id": "a", "op": "SELECT_EXACT", "args": {"type": "NATION", "property": "n_regionkey", "value": 0}, "output_binding": "$a"}, {"step_id": "b", "op": "ASSERT", "args": {"claim": "nations of region 0", "sources": "$a", "confidence_threshold": 0.1}, "output_binding": "$b", "depends_on": ["a"]}]
    result = Executor(g, AS_OF).run(Plan.from_dict({"steps": steps, "constraints": {"timeout_ms": 600_000}}))
    return lines_of(spark, {"answer": verify.synthesize(g, result, "q"), "nothing": verify.synthesize(g, Executor(g, AS_OF).run(Plan([])), "q")})


# Datasets


@query(f"select count(*) // 4 as walks, true as from_live_nodes, true as along_edges, true as short, true as plans_fit from (select 1 from customer where {live('c_custkey')} union all select 1 from nation where {live('n_nationkey')} union all select 1 from region where {live('r_regionkey')})")
def walk_invariants(spark, sf):
    """What every random walk and its plan have in common, whatever was drawn."""
    g, walks = walked(spark, sf)
    pairs = dataset.pairs(g, walks)
    hop = walks.select("walk", F.posexplode("relations").alias("i", "type_id"), "path").select("walk", F.get("path", F.col("i")).alias("source"), F.get("path", F.col("i") + 1).alias("target"), "type_id")
    off = hop.join(g.live_edges.select("source", "target", "type_id"), ["source", "target", "type_id"], "left_anti").select("walk").distinct().withColumn("off", F.lit(True))
    starts = g.live.select(F.col("id").alias("walk"), F.lit(True).alias("alive"))
    steps = F.array_size(F.from_json("plan", "struct<steps: array<struct<op: string>>>")["steps"])
    rows = walks.join(pairs, "walk").join(off, "walk", "left").join(starts, "walk", "left")
    return rows.agg(F.count("*").alias("walks"), F.bool_and(F.coalesce("alive", F.lit(False))).alias("from_live_nodes"), F.bool_and(F.col("off").isNull()).alias("along_edges"), F.bool_and((F.size("relations") <= 3) & (F.size("path") == F.size("relations") + 1)).alias("short"), F.bool_and(steps == F.size("relations") + 2).alias("plans_fit"))


def drawn_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 15))::bigint"


@query(f"""with n as (select count(*) as n from orders), o as (select o_orderkey, row_number() over (order by {drawn_sql("o_orderkey", "'7'")}, o_orderkey) as nth from orders)
select o_orderkey, case when nth <= floor(n * 0.7) then 'train' when nth <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as part from o, n""")
def dataset_split(spark, sf):
    return dataset.split(table(spark, sf, "orders"), "o_orderkey", 7).select("o_orderkey", "part")


# The walks in SQL: the same draws, hop by hop.
def walks_sql(seed: int) -> str:
    hop = lambda k: f"""w{k + 1} as (select w.walk, w.label, case when e.target is null then w.path else list_append(w.path, e.target) end as path, case when e.target is null then w.relations else list_append(w.relations, e.relation) end as relations, want
from w{k} w left join g d on d.source = w.path[-1] and len(w.path) = {k + 1} and want > {k} left join e on e.source = d.source and e.nth = {drawn_sql("walk", f"'{seed}'", f"'{k}'")} % d.degree)"""  # noqa: E731
    return f"""n as (select 'customer:' || c_custkey as id, c_name as label from customer where {live('c_custkey')} union all select 'nation:' || n_nationkey, n_name from nation where {live('n_nationkey')} union all select 'region:' || r_regionkey, r_name from region where {live('r_regionkey')}),
l as (select 'customer:' || c_custkey as source, 'nation:' || c_nationkey as target, 'IN_NATION' as relation from customer where {live_edge('c_custkey')} union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' from supplier where {live_edge('s_suppkey')} union all select 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' from nation where {live_edge('n_nationkey')}),
e as (select *, row_number() over (partition by source order by source || '>' || relation || '>' || target) - 1 as nth from l where target in (select id from n)), g as (select source, count(*) as degree from e group by 1),
w0 as (select id as walk, label, [id] as path, []::varchar[] as relations, {drawn_sql("id", f"'{seed + 1}'")} % 3 + 1 as want from n order by {drawn_sql("id", f"'{seed}'")}, id limit (select count(*) // 4 from n)), """ + ", ".join(map(hop, range(3)))


def walked(spark, sf, seed: int = 3):
    """Walks from a quarter of the live nodes."""
    g = load(spark, sf, ["CUSTOMER", "NATION", "REGION"], ["IN_NATION", "IN_REGION"])
    return g, dataset.random_walks(g, g.live.count() // 4, seed)


STEP = """'{"step_id":"s' || i || '","op":"TRAVERSE","args":{"node":"$b' || (i - 1) || '","rel":"' || relations[i] || '","direction":"out"},"output_binding":"$b' || i || '","depends_on":["s' || (i - 1) || '"]}'"""


@query(f"""with {walks_sql(3)}, p as (select w.walk, len(relations) as k, relations, case when len(relations) > 0 then 'how is ' || w.label || ' related to ' || b.label || '?' else 'what is ' || w.label || '?' end as query from w3 w join n b on b.id = w.path[-1])
select walk, query, '{{"steps":[' || array_to_string(list_concat(['{{"step_id":"s0","op":"SELECT_BY_ID","args":{{"id":"' || walk || '"}},"output_binding":"$b0","depends_on":[]}}'], list_transform(range(1, k + 1), lambda i: {STEP}),
['{{"step_id":"s' || (k + 1) || '","op":"ASSERT","args":{{"claim":"' || query || '","sources":"$b' || k || '","confidence_threshold":0.6}},"output_binding":"$b' || (k + 1) || '","depends_on":["s' || k || '"]}}']), ',') || ']}}' as plan from p""")
def dataset_pairs(spark, sf):
    return dataset.pairs(*walked(spark, sf))
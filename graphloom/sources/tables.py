"""The driver's relational tables as a property graph.

Only the tables behind the types and relations asked for are read. Ids are
`<type>:<key>`. Fixture conventions, the same in the oracles: confidence 0.5 + (key mod
50) / 100, deprecated where key mod 17 = 0 (edges: mod 23), and as_of 2024-01-31.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import turn_embedding
from ..graph import Graph, TypeSource
from ..model import EDGE_COLUMNS, NODE_COLUMNS, NodeType, PROVENANCE_COLUMNS, Rule, Schema

AS_OF = datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core that `spread` deals rows to.
WAVES = 4


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt by key over all cores: a file of one row group is read by one task, which would do all work on it."""
    return rows.repartition(WAVES * rows.sparkSession.sparkContext.defaultParallelism, *key)


def _nodes(df: DataFrame, type_id: str, key: Column, node_id: Column, label: Column, properties: dict[str, Column], at: Column | None = None, embedding: Column | None = None, prefix: str | None = None, number: str | None = None) -> TypeSource:
    """prefix, number: where an id is the prefix before that column."""
    at = F.lit(AS_OF).cast("timestamp_ntz") if at is None else at

    def make(rows: DataFrame) -> DataFrame:
        return rows.select(
            node_id.alias("id"), F.lit(type_id).alias("type_id"), label.cast("string").alias("label"), (F.lit(None) if embedding is None else embedding).cast("array<float>").alias("embedding"),
            F.to_json(F.struct(*(c.alias(n) for n, c in properties.items()))).alias("properties"), F.lit(None).cast("string").alias("content_ref"), (F.lit(0.5) + F.pmod(key, F.lit(50)) / F.lit(100.0)).alias("confidence"),
            F.lit(1).alias("version"), at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), (F.pmod(key, F.lit(17)) == 0).alias("deprecated"), F.concat(F.lit("prov:"), F.lit(type_id)).alias("provenance_id"),
        )

    return TypeSource(df, properties, make, prefix and f"{prefix}:", number)


def _edges(df: DataFrame, type_id: str, key: Column, source: Column, target: Column, nth: Column | None = None) -> DataFrame:
    return df.select(
        F.concat_ws(">", source, F.lit(type_id), target, *([] if nth is None else [nth.cast("string")])).alias("id"), source.alias("source"), target.alias("target"), F.lit(type_id).alias("type_id"), F.lit(1.0).alias("weight"),
        (F.lit(0.5) + F.pmod(key, F.lit(50)) / F.lit(100.0)).alias("confidence"), F.lit(True).alias("directional"), F.lit(1).alias("version"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), (F.pmod(key, F.lit(23)) == 0).alias("deprecated"),
        F.concat(F.lit("prov:"), F.lit(type_id)).alias("provenance_id"), F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"),
    )


def ref(prefix: str, *keys: Column | str) -> Column:
    return F.concat_ws(":", F.lit(prefix), *(k if isinstance(k, Column) else F.col(k).cast("string") for k in keys))


def _keyed(name: str, prefix: str, key: str, label: str, skip: tuple[str, ...] = ()):
    def make(spark, sf_dir, type_id):
        df = table(spark, sf_dir, name)
        return _nodes(df, type_id, F.col(key), ref(prefix, key), F.col(label), {c: F.col(c) for c in df.columns if c != key and c not in skip}, prefix=prefix, number=key)

    return make


def _events(spark, sf_dir, type_id):
    e = table(spark, sf_dir, "events")
    level1 = (F.col("event_type") == "error") & (F.col("value") > 100)
    k = F.get_json_object("props", "$.k").cast("bigint")
    if type_id == "INTERRUPT_L1":
        e, prefix = e.where(level1), "l1"
        props = {"trigger_metric": F.lit("value"), "trigger_value": F.col("value"), "threshold": F.lit(100.0), "action": F.lit("page"), "session_id": F.col("user_id").cast("string"), "resolved": F.col("event_id") % 2 == 0}
    elif type_id == "INTERRUPT_L2":
        e, prefix = e.where("event_type <> 'error'"), "l2"
        props = {"pattern": F.col("event_type"), "salience_score": F.least(F.lit(1.0), F.col("value") / 200), "action": F.lit("note")}
    else:
        prefix, props = "event", {"event_type": F.col("event_type"), "source": F.col("user_id").cast("string"), "value": F.col("value"), "k": k}
    return _nodes(e, type_id, F.col("event_id"), ref(prefix, "event_id"), F.col("event_type"), props, F.col("ts").cast("timestamp_ntz"), prefix=prefix, number="event_id")


def _sessions(spark, sf_dir, type_id):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return _nodes(c, type_id, F.col("conv_id"), ref("session", "conv_id"), F.col("conv_id"), {"session_id": F.col("conv_id").cast("string")}, prefix="session", number="conv_id")


def _turns(spark, sf_dir, type_id):
    c = table(spark, sf_dir, "conversations")
    at = (F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("conv_id") * 1000 + F.col("turn")).cast("decimal(18,6)")))
    props = {"session_id": F.col("conv_id").cast("string"), "turn_index": F.col("turn"), "role": F.col("role"), "text": F.col("text"), "timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")}
    label = F.concat(F.col("role"), F.lit("["), F.col("turn").cast("string"), F.lit("]@"), F.substring(F.col("conv_id").cast("string"), 1, 8))
    return _nodes(c, type_id, F.col("conv_id") + F.col("turn"), ref("turn", "conv_id", "turn"), label, props, at, turn_embedding(F.col("role"), F.col("text")))


def _docs(spark, sf_dir, type_id):
    d = table(spark, sf_dir, "documents")
    return _nodes(d, type_id, F.col("doc_id"), ref("doc", "doc_id"), F.col("doc_id"), {"path": F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), "lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars")}, prefix="doc", number="doc_id")


def _vectors(spark, sf_dir, type_id):
    v = table(spark, sf_dir, "embeddings")
    return _nodes(v, type_id, F.col("vec_id"), ref("vector", "vec_id"), F.col("label"), {"label": F.col("label")}, embedding=F.col("embedding"), prefix="vector", number="vec_id")


NODES = {
    "REGION": _keyed("region", "region", "r_regionkey", "r_name"), "NATION": _keyed("nation", "nation", "n_nationkey", "n_name"), "CUSTOMER": _keyed("customer", "customer", "c_custkey", "c_name"),
    "SUPPLIER": _keyed("supplier", "supplier", "s_suppkey", "s_name"), "PART": _keyed("part", "part", "p_partkey", "p_name"), "ORDER": _keyed("orders", "order", "o_orderkey", "o_orderstatus"),
    "PAGE": _keyed("pages", "page", "page_id", "url", ("html",)), "EVENT_LOG": _events, "INTERRUPT_L1": _events, "INTERRUPT_L2": _events, "SESSION": _sessions, "CONVERSATION_TURN": _turns, "DOC": _docs, "VECTOR": _vectors,
}


def _link(name: str, source: tuple[str, str], target: tuple[str, str], key: str):
    def make(spark, sf_dir, type_id):
        return _edges(table(spark, sf_dir, name), type_id, F.col(key), ref(*source), ref(*target))

    return make


def _in_nation(spark, sf_dir, type_id):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return _edges(c, type_id, F.col("c_custkey"), ref("customer", "c_custkey"), ref("nation", "c_nationkey")).union(_edges(s, type_id, F.col("s_suppkey"), ref("supplier", "s_suppkey"), ref("nation", "s_nationkey")))


def _has_part(spark, sf_dir, type_id):
    return _edges(table(spark, sf_dir, "lineitem"), type_id, F.col("l_orderkey") + F.col("l_partkey"), ref("order", "l_orderkey"), ref("part", "l_partkey"), F.col("l_linenumber"))


def _supplied_by(spark, sf_dir, type_id):
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return _edges(pairs, type_id, F.col("l_partkey") + F.col("l_suppkey"), ref("part", "l_partkey"), ref("supplier", "l_suppkey"))


def _follows(spark, sf_dir, type_id):
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    return _edges(c, type_id, F.col("conv_id") + F.col("turn"), ref("turn", "conv_id", "turn"), ref("turn", "conv_id", (F.col("turn") - 1).cast("string")))


EDGES = {
    "IN_REGION": _link("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "n_nationkey"), "IN_NATION": _in_nation, "PLACED_BY": _link("orders", ("order", "o_orderkey"), ("customer", "o_custkey"), "o_orderkey"),
    "HAS_PART": _has_part, "SUPPLIED_BY": _supplied_by, "FOLLOWS": _follows,
    "PART_OF": lambda spark, sf_dir, t: _edges(table(spark, sf_dir, "conversations"), t, F.col("conv_id") + F.col("turn"), ref("turn", "conv_id", "turn"), ref("session", "conv_id")),
    "INTERRUPT_OF": lambda spark, sf_dir, t: _edges(table(spark, sf_dir, "events").where("event_type <> 'error'"), t, F.col("event_id"), ref("l2", "event_id"), ref("event", "event_id")),
}

# Types of the driver's tables; relations and required properties are checked against these. That a
# supplier's nation is declared a region is on purpose: the violation query has something to find.
TABLE_SCHEMA = Schema(
    {
        "REGION": NodeType(None, {"r_name": ("string", True, ())}), "NATION": NodeType(None, {"n_name": ("string", True, ())}, {"IN_REGION": "REGION"}),
        "CUSTOMER": NodeType(None, {"c_mktsegment": ("enum", True, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"))}, {"IN_NATION": "NATION"}), "SUPPLIER": NodeType(None, {"s_name": ("string", True, ())}, {"IN_NATION": "REGION"}),
        "PART": NodeType(None, {}, {"SUPPLIED_BY": "SUPPLIER"}), "ORDER": NodeType(None, {}, {"PLACED_BY": "CUSTOMER", "HAS_PART": "PART"}), "DOC": NodeType(None, {}), "VECTOR": NodeType(None, {}), "PAGE": NodeType(None, {}),
        "EVENT_LOG": NodeType(None, {}), "INTERRUPT_L1": NodeType(None, {}), "INTERRUPT_L2": NodeType(None, {}, {"INTERRUPT_OF": "EVENT_LOG"}), "SESSION": NodeType(None, {}), "CONVERSATION_TURN": NodeType(None, {}, {"FOLLOWS": "CONVERSATION_TURN", "PART_OF": "SESSION"}),
    },
    {"customer_region": Rule("customer_region", ["IN_NATION", "IN_REGION"]), "order_supplier": Rule("order_supplier", ["HAS_PART", "SUPPLIED_BY"])},
)


def load(spark: SparkSession, sf_dir: str, types: list[str], relations: list[str] = ()) -> Graph:
    """A graph of these node types and relations."""
    made = {t: NODES[t](spark, sf_dir, t) for t in types}
    linked = [EDGES[r](spark, sf_dir, r) for r in relations]
    nodes = reduce(DataFrame.unionByName, (x.nodes for x in made.values())) if made else spark.createDataFrame([], NODE_COLUMNS)
    edges = reduce(DataFrame.unionByName, linked) if linked else spark.createDataFrame([], EDGE_COLUMNS)
    rows = [(f"prov:{t}", "db_query", f"table:{t.lower()}", "tables", AS_OF, None, None, "trusted") for t in [*types, *relations]]
    return Graph(nodes, edges, spark.createDataFrame(rows, PROVENANCE_COLUMNS), schema=TABLE_SCHEMA, sources=made)

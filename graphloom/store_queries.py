"""Queries over what the engine stores, streams and reads back: files, indexes, transcripts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import tables
from .operators import asof, dataset, events, retrieval, statistics, storage, vectors
from .operators.state import shared_root
from .queries import SCORED, conf, first_vector, live, live_edge, query, walked, walks_sql
from .sources import files, jsonl, sqlite, transcripts
from .sources.store import GraphStore
from .sources.tables import AS_OF, load, spread, table
from .streaming import turns


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def folders_of_text(rows, key: str, folder: str) -> None:
    """A folder of text for each key. Tasks move their own files to their places (names are of their own), not the driver
    one after another."""
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(folder)


# SQLite files


@query(f"""select 'customer:' || c_custkey as id, c_name as label, round({conf('c_custkey')}, 4) as confidence, c_mktsegment as segment, timestamp '2024-01-31' as updated_at, 'nation:' || c_nationkey as nation, n_name as nation_label
from customer join nation on n_nationkey = c_nationkey where {live('c_custkey')} and {conf('c_custkey')} >= 0.6 and {live_edge('c_custkey')}""")
def sqlite_graph(spark, sf):
    """Customers, nations and their edges written to SQLite files and read back, customers by a pushed filter."""
    g, folder = load(spark, sf, ["CUSTOMER", "NATION"], ["IN_NATION"]), scratch(spark, "sqlite")
    sqlite.write(g.nodes, folder)
    sqlite.write(g.edges, folder, "edges")
    customers = sqlite.selected(spark, folder, "nodes", "type_id = 'CUSTOMER' and not deprecated and confidence >= 0.6")
    nations = sqlite.selected(spark, folder, "nodes", "type_id = 'NATION'").select(F.col("id").alias("nation"), F.col("label").alias("nation_label"))
    edges = sqlite.selected(spark, folder, "edges", "type_id = 'IN_NATION' and not deprecated").select(F.col("source").alias("id"), F.col("target").alias("nation"))
    segment = F.get_json_object("properties", "$.c_mktsegment").alias("segment")
    return customers.join(edges, "id").join(nations, "nation").select("id", "label", F.round("confidence", 4).alias("confidence"), segment, "updated_at", "nation", "nation_label")


# The index of vectors


def indexed(spark, sf):
    """A graph of vectors behind an index of two segments: label 1, then the rest."""
    g = load(spark, sf, ["VECTOR"])
    index = vectors.VectorIndex(spark, scratch(spark, "vectors"), 64)
    index.add(g.nodes.where(F.pmod(F.xxhash64("id"), F.lit(3)) > 0))
    index.add(g.nodes)
    g.index = index
    return g


@query(f"with s as ({SCORED}) select 'vector:' || vec_id as id, round(score, 4) as score from s order by s.score desc, 'vector:' || vec_id limit 25")
def vector_index(spark, sf):
    """The 25 nearest by an index, which reads the cells that may hold them."""
    return indexed(spark, sf).index.query(first_vector(spark, sf), 25, exact=True).select("id", F.round("score", 4).alias("score"))


@query("select 20 as queries, true as recall_reached, true as few_vectors_read")
def vector_index_recall(spark, sf):
    """Approximate searches of the graph against exact ones: the ten nearest of 20 vectors."""
    g, hits, read, total = indexed(spark, sf), 0, 0, 0
    asked = g.nodes.orderBy(F.xxhash64("id")).limit(20).select("embedding").collect()
    for (v,) in asked:
        exact = {r["id"] for r in g.index.query(v, 10, exact=True).collect()}
        found = g.index.search(v, 10)
        hits += len(exact & {r["id"] for r in found.hits.collect()})
        read, total = read + found.vectors, total + found.total
    return spark.createDataFrame([(len(asked), hits >= 0.9 * 10 * len(asked), read < 0.2 * total)], "queries int, recall_reached boolean, few_vectors_read boolean")


@query(f"with s as ({SCORED}), t as (select * from s order by score desc, 'vector:' || vec_id limit 3) select 'vector:' || vec_id as id, round(score, 4) as score from t where score >= 0.2 and {live('vec_id')} order by t.score desc, 'vector:' || vec_id limit 1")
def select_approx_indexed(spark, sf):
    """SELECT_APPROX through the index; the best hit is the vector asked for."""
    g = indexed(spark, sf)
    return retrieval.select_approx(g, F.array(*map(F.lit, first_vector(spark, sf))), 1, 0.2).df.select("id", F.round("score", 4).alias("score"))


# Transcripts


@query("""with t as (select conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text, length(text) + turn + conv_id % 100 as tokens from conversations),
u as (select conv_id, arg_max(tokens, turn) filter (role = 'assistant') as tokens from t group by 1)
select conv_id::bigint as conv_id, role as kind, substr(arg_max(text, turn) filter (text <> ''), 1, case when role = 'user' then 2000 else 1000000 end) as text, coalesce(any_value(u.tokens), 0) * 100 // 5000 as percent from t join u using (conv_id) group by conv_id, role""")
def transcript_messages(spark, sf):
    """Conversations written as transcripts of several shapes, with broken lines between; the last message of each kind and
    the context in use, read back."""
    folder, t = scratch(spark, "transcripts"), table(spark, sf, "conversations")
    words = F.split("text", " ", 2)
    part = lambda c: F.to_json(F.struct(F.lit("text").alias("type"), c.alias("text")))
    blocks = F.concat_ws(",", part(words[0]), F.lit('{"type":"tool_use","id":7}'), F.lit("12"), F.when(F.size(words) > 1, part(words[1])))
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9)).otherwise(F.concat(F.lit("["), blocks, F.lit("]")))
    usage = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), (F.col("conv_id") % 100).alias("cache_read_input_tokens")))).otherwise("null")
    message = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":'), content, F.lit(',"usage":'), usage, F.lit("}"))
    as_text = F.to_json(F.struct(message.alias("m"))).substr(F.lit(6), F.length(F.to_json(F.struct(message.alias("m")))) - 6)  # a message as JSON text
    line = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('","message":'), F.when(F.col("turn") % 3 == 0, as_text).otherwise(message), F.lit("}"))
    lines = t.select("conv_id", "turn", F.explode(F.array(line, F.lit('{"type":"user","message":{"content":"cut off'), F.lit('{"type":"user","message":[1]}'))).alias("value"))
    folders_of_text(spread(lines, "conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "value"), "conv_id", folder)
    both = transcripts.last_messages_in_context(transcripts.read_messages(spark, folder), 5000)
    return both.select(F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), "kind", "text", "percent")


# Turns as they are said


@query("""with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn) - 1 as turn from conversations where trim(text) <> '')
select conv_id::varchar as session_id, turn as turn_index, 'turn:' || conv_id || ':' || turn as id, case when turn > 0 then 'turn:' || conv_id || ':' || (turn - 1) end as previous, role, text, turn = 0 as opens from t""")
def turn_stream(spark, sf):
    """Conversations streamed in three runs, each from the checkpoint of the one before; the later ones find messages again
    that came before."""
    folder, t = scratch(spark, "turns"), table(spark, sf, "conversations")
    messages = t.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", "text", F.timestamp_seconds(1704067200 + 60 * F.col("turn")).alias("at"))
    for part in ("seq < 2", "seq between 1 and 4", "seq >= 3"):
        messages.where(part).write.mode("append").parquet(f"{folder}/messages")
        turns.ingest(spark, f"{folder}/messages", f"{folder}/turns", f"{folder}/checkpoint")
    return spark.read.schema(turns.TURNS).parquet(f"{folder}/turns")


# Table functions

# Python texts of several shapes, `#` standing for a key, and their symbols as (kind, name, line, inside, is_async).
SHAPES = {
    "import os.path\nfrom a.b import c\nfrom . import d\n\nasync def f#():\n    def inner():\n        import sys\n    return inner\n": [("import", "os.path", 1, None, False), ("import", "a.b", 2, None, False), ("function", "f#", 5, None, True), ("function", "inner", 6, "f#", False), ("import", "sys", 7, "f#.inner", False)],
    "class K#(Base):\n    class Inner:\n        async def m(self): pass\n    @property\n    def p(self): return lambda: 1\n": [("class", "K#", 1, None, False), ("class", "Inner", 2, "K#", False), ("function", "m", 3, "K#.Inner", True), ("function", "p", 5, "K#", False)],
    "def broken#(:\n": [],
    "": [],
    "if x:\n    import one, two\nelse:\n    def g#(): pass\n": [("import", "one", 2, None, False), ("import", "two", 2, None, False), ("function", "g#", 4, None, False)],
}


def told_sql() -> str:
    """Each shape's symbols as rows in SQL."""
    value = lambda v: "null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'"
    return ", ".join(f"({k}, {', '.join(map(value, r))})" for k, rows in enumerate(SHAPES.values()) for r in rows)


@query(f"""with s(shape, kind, name, line, inside, is_async) as (values {told_sql()})
select p_partkey, kind, replace(name, '#', p_partkey::varchar) as name, line::int as line, replace(inside, '#', p_partkey::varchar) as inside, is_async from part join s on shape = p_partkey % {len(SHAPES)}""")
def python_symbols_lateral(spark, sf):
    """A Python file for each part; its symbols by a table function in SQL."""
    tables.register(spark)
    texts = F.get(F.array(*map(F.lit, SHAPES)), F.col("p_partkey") % len(SHAPES))
    spread(table(spark, sf, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.replace(texts, F.lit("#"), F.col("p_partkey").cast("string")).cast("binary").alias("content")).createOrReplaceTempView("python_files")
    return spark.sql("select p_partkey, s.kind, s.name, s.line, s.inside, s.is_async from python_files, lateral python_symbols(content, true) s")


# The graph as it was


@query("""with v as (select user_id, ts as since, event_id as version_event, value as balance from events where event_type = 'purchase')
select e.event_id, e.event_type, e.ts, e.user_id, v.since, v.version_event, v.balance from (select * from events where event_type <> 'purchase') e asof left join v on e.user_id = v.user_id and e.ts >= v.since""")
def asof_versions(spark, sf):
    """Each event with the version of its user's node that held then: a purchase makes one."""
    e = table(spark, sf, "events")
    versions = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("version_event"), F.col("value").alias("balance"))
    rows = e.where("event_type <> 'purchase'").select("event_id", "event_type", "ts", "user_id")
    return asof.asof_join(rows, versions, "user_id", "ts", "since", "version_event")


@query(f"""with r as (select 'event:' || user_id as id, row_number() over (partition by user_id order by ts)::int as version, ts, event_type = 'error' as deprecated, ts + interval 3 day as valid_until from events)
select id, version, ts as updated_at, deprecated from r where ts <= timestamp '2024-01-15' qualify row_number() over (partition by id order by version desc) = 1 and valid_until > timestamp '2024-01-15'""")
def graph_as_of(spark, sf):
    """A version of its user's node for each event, valid for three days; the graph as it was in the middle of the month."""
    from datetime import datetime

    from pyspark.sql.window import Window

    g = load(spark, sf, ["EVENT_LOG"])
    e = table(spark, sf, "events").select(F.concat(F.lit("event:"), F.col("user_id").cast("string")).alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("version"), F.col("ts").cast("timestamp_ntz").alias("updated_at"), (F.col("event_type") == "error").alias("deprecated"))
    e = e.withColumn("valid_until", F.col("updated_at") + F.expr("interval 3 day"))
    g.nodes = e.select(*(F.col(c) if c in e.columns else F.lit(None).alias(c) for c in g.nodes.columns))
    return asof.as_of(g, datetime(2024, 1, 15)).nodes.select("id", "version", "updated_at", "deprecated")


# Statistics that are merged


@query("""with e as (select event_type as name, date_trunc('week', ts)::date as week, event_id, value from events)
select name, week, count(*) as n, round(avg(event_id % 100 / 100.0), 6) as confidence_avg, true as distinct_near, true as median_near from e group by grouping sets ((name, week), (name), (week), ())""")
def statistics_report(spark, sf):
    """Events summarised in two ingests, reported over grouping sets; sketches against exact figures."""
    e = table(spark, sf, "events").select("event_type", "user_id", "event_id", (F.col("event_id") % 100 / 100.0).alias("confidence"), F.lit(False).alias("deprecated"), F.col("ts").alias("created_at"))
    stats = statistics.Statistics(spark, scratch(spark, "statistics"))
    for part in (0, 1):
        stats.add(statistics.summarised(e.where(F.pmod("event_id", F.lit(2)) == part), "node", f"ingest {part}", "event_type", "user_id"))
    told = stats.report([("name", "week"), ("name",), ("week",), ()], (0.5,))
    week = statistics.week_of(F.col("created_at")).alias("week")
    exact = e.select(F.col("event_type").alias("name"), week, "user_id", "confidence").groupingSets([[F.col("name"), F.col("week")], [F.col("name")], [F.col("week")], []], "name", "week").agg(F.countDistinct("user_id").alias("users"), F.percentile("confidence", F.array(F.lit(0.45), F.lit(0.55))).alias("near"))
    both = told.alias("t").join(exact.alias("x"), F.col("t.name").eqNullSafe(F.col("x.name")) & F.col("t.week").eqNullSafe(F.col("x.week")))
    median = F.col("quantiles")[0]
    return both.select("t.name", "t.week", "n", F.round("confidence_avg", 6).alias("confidence_avg"), (F.abs(F.col("distinct_keys") - F.col("users")) <= 1 + F.col("users") * 0.08).alias("distinct_near"), ((median >= F.col("near")[0]) & (median <= F.col("near")[1])).alias("median_near"))


# Versions


@query(f"""select 'customer:' || c_custkey as id, (1 + (c_custkey % 3 = 0)::int + (c_custkey % 7 = 0)::int)::int as version, {live('c_custkey')} is false or c_custkey % 5 = 0 as deprecated,
round(case when c_custkey % 7 = 0 then 0.2 when c_custkey % 3 = 0 then 0.1 else {conf('c_custkey')} end, 4) as confidence from customer""")
def store_generations(spark, sf):
    """Customers stored, updated, deprecated, compacted, and some updated again."""
    store, g = GraphStore(spark, scratch(spark, "store")), load(spark, sf, ["CUSTOMER"])
    key = F.substring("id", 10, 20).cast("long")
    changed = lambda every, value: g.nodes.where(key % every == 0).select("id", F.lit(value).alias("confidence"))
    store.add("nodes", g.nodes)
    store.add("nodes", storage.update_nodes(store.current("nodes"), changed(3, 0.1), AS_OF))
    store.compact("nodes")
    store.add("nodes", storage.deprecate(store.current("nodes"), g.nodes.where(key % 5 == 0)))
    store.compact("nodes")
    store.add("nodes", storage.update_nodes(store.current("nodes"), changed(7, 0.2), AS_OF))
    return store.current("nodes").select("id", "version", "deprecated", F.round("confidence", 4).alias("confidence"))


# Directories and datasets


@query("select s_suppkey, 'DOC' as type_id, 'text' as format, sha256(s_name || chr(10)) as hash from supplier")
def directory_walk(spark, sf):
    """A folder with a text for each supplier, in folders of their own, beside folders that are passed over and files of
    unknown kinds; what the walk finds."""
    root, s = scratch(spark, "project"), table(spark, sf, "supplier")
    folders_of_text(spread(s.select("s_suppkey", "s_name"), "s_suppkey"), "s_suppkey", f"{root}/docs")
    for name in ("node_modules", "docs/build", "__pycache__"):
        s.select("s_name").coalesce(1).write.text(f"{root}/{name}")
    s.select("s_suppkey").coalesce(1).write.parquet(f"{root}/tables")
    found = files.contents(files.read_files(spark, root), "type_id")
    return found.select(F.regexp_extract("source_uri", r"^docs/s_suppkey=(\d+)/part-", 1).cast("long").alias("s_suppkey"), "type_id", "format", "hash")


@query(f"with {walks_sql(5)} select case when len(relations) > 0 then 'how is ' || w.label || ' related to ' || b.label || '?' else 'what is ' || w.label || '?' end as query, (len(relations) + 2)::int as steps from w3 w join n b on b.id = w.path[-1]")
def pairs_jsonl(spark, sf):
    """Pairs of queries and plans written as JSON Lines and read back."""
    path = f"{scratch(spark, 'pairs')}/lines"
    jsonl.write_pairs(dataset.pairs(*walked(spark, sf, 5)), path)
    return spark.read.schema("query string, plan struct<steps: array<struct<step_id: string>>>").json(path).select("query", F.size("plan.steps").alias("steps"))


# Revisions and outcomes


@query("""with c as (select 'challenge:' || event_id as c, 'event:' || event_id as e, 'outcome:' || event_id as o, 'revision:' || event_id as r, value from events where event_type = 'error')
select c as source, 'CHALLENGED_BY' as relation, e as target, 'resolved' as status from c union all select r, 'SUPERSEDES', e, case when value > 100 then 'promoted' else 'rejected' end from c union all select c, 'RESOLVED_TO', o, case when value > 100 then 'override' else 'defer' end from c""")
def write_arbitration(spark, sf):
    """Errors challenged, revised and arbitrated: the three edges, each with its record's status after the outcome."""
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    name = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("event_id").cast("string"))
    event, challenge, revision, outcome, high = name("event"), name("challenge"), name("revision"), name("outcome"), F.col("value") > 100
    sure = F.least(F.lit(1.0), F.col("value") / 200)
    challenges = events.record(e, "ARC_CHALLENGE", {"target_node_id": event, "challenge_type": F.lit("contradiction"), "evidence": F.col("props"), "arc_confidence": sure, "ecl_status": F.lit("pending")}, challenge, F.col("at"))
    revisions = events.record(e, "ARC_REVISION", {"original_node_id": event, "proposed_content": F.col("props"), "revision_type": F.lit("update"), "arc_confidence": sure, "status": F.lit("proposed")}, revision, F.col("at"))
    outcomes = events.record(e, "ARBITRATION_OUTCOME", {"outcome": F.when(high, "override").otherwise("defer"), "challenger_id": challenge, "challenged_id": event, "ecl_confidence": sure, "reason": F.lit("value")}, outcome, F.col("at"))
    edges = [events.relation(e, challenge, event, "CHALLENGED_BY", F.col("at")), events.relation(e, revision, event, "SUPERSEDES", F.col("at")), events.relation(e, challenge, outcome, "RESOLVED_TO", F.col("at"))]
    store = GraphStore(spark, scratch(spark, "arbitration"))
    for nodes in (challenges, revisions, outcomes):
        store.add("nodes", nodes)
    for rows in edges:
        store.add("edges", rows)
    store.compact("nodes")
    won = e.select(revision.alias("id"), F.when(high, "promoted").otherwise("rejected").alias("to"))
    now = store.current("nodes")
    store.add("nodes", events.set_property(now.where("type_id = 'ARC_CHALLENGE'"), "ecl_status", F.lit("resolved"), AS_OF))
    store.add("nodes", events.set_property(now.where("type_id = 'ARC_REVISION'").join(won, "id"), "status", F.col("to"), AS_OF).drop("to"))
    p = F.col("properties")
    status = store.current("nodes").select("id", F.coalesce(F.get_json_object(p, "$.outcome"), F.get_json_object(p, "$.status"), F.get_json_object(p, "$.ecl_status")).alias("status"))
    told = store.current("edges").withColumn("of", F.when(F.col("type_id") == "RESOLVED_TO", F.col("target")).otherwise(F.col("source")))
    return told.join(status, told.of == status.id).select("source", F.col("type_id").alias("relation"), "target", "status")

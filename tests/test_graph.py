"""Edge cases of the graph operators on small hand-made graphs."""

import json
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions.conditions import condition
from graphloom.functions.properties import equals
from graphloom.graph import Graph, Nodes
from graphloom.model import DEFAULT_SCHEMA, EDGE_COLUMNS, NODE_COLUMNS, PROVENANCE_COLUMNS, Rule, Schema
from graphloom.operators import conversations, dataset, events, lists, meta, navigation, reasoning, retrieval, storage
from graphloom.plans.executor import Executor, resolve
from graphloom.plans.plan import Plan, Step, default_plan, ordered, validate
from graphloom.plans.verify import node_violations, synthesize, verify

NOW = datetime(2024, 1, 31)


def node(i, type_id="T", props=None, confidence=0.9, deprecated=False, embedding=None, at=NOW):
    text = props if isinstance(props, str) else json.dumps(props or {})
    return (i, type_id, i.upper(), embedding, text, None, confidence, 1, at, at, None, deprecated, "p")


def edge(source, target, type_id="R", confidence=0.9, deprecated=False, nth=0):
    return (f"{source}{type_id}{target}{nth}", source, target, type_id, 1.0, confidence, True, 1, None, deprecated, "p", NOW)


def graph(spark, nodes, edges=(), rules=()):
    return Graph(
        spark.createDataFrame(list(nodes), NODE_COLUMNS), spark.createDataFrame(list(edges), EDGE_COLUMNS),
        spark.createDataFrame([("p", "file", "/p", "t", NOW, None, None, "trusted")], PROVENANCE_COLUMNS), schema=Schema(DEFAULT_SCHEMA.types, {r.rule_id: r for r in rules}),
    )


@pytest.fixture(scope="module")
def web(spark):
    """A cycle, a self-loop, parallel edges, a deprecated middle and a dangling target."""
    nodes = [node("a"), node("b"), node("c", deprecated=True), node("d"), node("e")]
    edges = [edge("a", "b"), edge("a", "b", nth=1), edge("b", "a"), edge("a", "a"), edge("b", "c"), edge("c", "d"), edge("a", "gone"), edge("gone", "e"), edge("a", "e", deprecated=True), edge("b", "e", "S")]
    return graph(spark, nodes, edges)


def got(nodes):
    return sorted(r["id"] for r in nodes.df.select("id").collect())


def one(g, i):
    return retrieval.select_by_id(g, i)


def test_traverse_is_a_bag(web):
    assert got(navigation.traverse(web, one(web, "a"), "R")) == ["a", "b", "b"]
    assert got(navigation.traverse(web, one(web, "a"), "R", "both")) == ["a", "a", "b", "b", "b"]
    assert got(navigation.traverse(web, one(web, "c"), "R", "in")) == ["b"]


def test_expand_walks_through_deprecated_and_missing(web):
    assert got(navigation.expand(web, one(web, "a"), None, 1)) == ["b"]
    assert got(navigation.expand(web, one(web, "a"), None, 2)) == ["b", "e"]
    assert got(navigation.expand(web, one(web, "a"), ["R"], 3)) == ["b", "d", "e"]


def test_paths(web):
    assert [r["path"] for r in navigation.path_find(web, "a", "a").collect()] == [["a"]]
    assert [r["path"] for r in navigation.path_find(web, "a", "d").collect()] == [["a", "b", "c", "d"]]
    assert sorted(r["path"] for r in navigation.path_find(web, "a", "e").collect()) == [["a", "b", "e"], ["a", "gone", "e"]]
    assert navigation.path_find(web, "e", "a").count() == 0


def test_subgraph_keeps_root_and_deprecated(web):
    nodes, edges = navigation.subgraph(web, "b", 1, ["R"])
    assert got(nodes) == ["a", "b", "c"]
    assert sorted((r["source"], r["target"]) for r in edges.collect()) == [("b", "a"), ("b", "c")]
    assert got(navigation.subgraph(web, "b", 0)[0]) == ["b"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14), st.integers(1, 3))
def test_expand_is_breadth_first_search(spark, pairs, hops):
    g = graph(spark, [node(str(i)) for i in range(7)], [edge(str(a), str(b), nth=k) for k, (a, b) in enumerate(pairs)])
    seen, front = {0}, {0}
    for _ in range(hops):
        front = {b for a, b in pairs if a in front} - seen
        seen |= front
    assert got(navigation.expand(g, one(g, "0"), None, hops)) == sorted(map(str, seen - {0}))


PROPS = [node("int", props={"x": 5}), node("float", props={"x": 5.0}), node("text", props={"x": "5"}), node("true", props={"x": True}), node("null", props={"x": None}), node("none"), node("broken", props="{oops")]


@pytest.mark.parametrize(("text", "ids"), [
    ("properties.x == 5", ["float", "int"]), ("properties.x == '5'", ["text"]), ("properties.x == 1", ["true"]), ("properties.x == true", ["true"]),
    ("properties.x != 5", ["broken", "none", "null", "text", "true"]), ("properties.x > 0", ["float", "int", "true"]), ("properties.x <= '9'", ["text"]),
    ("label == 'NONE'", ["none"]), ("label == 3", []), ("label != 3", sorted(p[0] for p in PROPS)), ("confidence >= 0.9", sorted(p[0] for p in PROPS)), ("deprecated == false", sorted(p[0] for p in PROPS)),
    ("properties.x == 5 AND label == 'x'", []), ("", []), (None, []), ("properties.a.b == 1", []),
])
def test_filter_language(spark, text, ids):
    g = graph(spark, PROPS)
    assert sorted(r["id"] for r in g.nodes.where(condition(text)).collect()) == ids


def test_select_exact_types(spark):
    g = graph(spark, PROPS)
    assert got(retrieval.select_exact(g, "T", "x", 1)) == ["true"]
    assert got(retrieval.select_exact(g, "T", "x", "5")) == ["text"]
    assert got(retrieval.select_exact(g, "T", "x", None)) == []
    assert got(retrieval.select_exact(g, "OTHER", "x", 5)) == []


def test_aggregates_count_booleans_and_skip_text(spark):
    every = Nodes(graph(spark, PROPS).nodes)
    value = lambda fn: lists.aggregate(every, fn, "x").first()["value"]
    assert (value("sum"), value("count"), value("max"), value("min")) == (11.0, 3.0, 5.0, 1.0)
    assert lists.aggregate(every, "avg", "y").first()["value"] == 0.0
    with pytest.raises(ValueError):
        lists.aggregate(every, "median", "x")


def test_sets_keep_left_duplicates(web):
    bag = navigation.traverse(web, one(web, "a"), "R")
    assert got(lists.intersect(bag, one(web, "b"))) == ["b", "b"]
    assert got(lists.difference(bag, one(web, "a"))) == ["b", "b"]
    assert got(lists.union(bag, one(web, "e"))) == ["a", "b", "e"]


def test_order_and_prefix(spark):
    g = graph(spark, [node("a", confidence=0.5), node("b", confidence=0.7), node("c", confidence=0.7, deprecated=True)])
    every = Nodes(g.nodes)
    assert [r["id"] for r in lists.top_k(lists.rank(every, F.col("confidence")), 2).df.collect()] == ["b", "c"]
    assert [r["id"] for r in lists.reduce_best(every).df.collect()] == ["b"]
    assert lists.top_k(every, 0).df.count() == 0
    with pytest.raises(ValueError):
        lists.top_k(every, -1)


def test_assert_reasons_in_order(web, spark):
    reason = lambda *i: reasoning.assert_claim(web, "x", spark.createDataFrame([(k,) for k in i], "id string"), 0.95).first()["unknown_reason"]
    assert [reason(), reason("c", "gone"), reason("c", "a"), reason("a")] == ["no_sources", "source_missing", "source_deprecated", "below_threshold: 0.90<0.95"]


def test_infer_chains_from_live_sources(spark):
    g = graph(spark, [node("a"), node("x", deprecated=True)], [edge("a", "m", "P", 0.5), edge("m", "z", "Q", 0.8), edge("x", "m", "P"), edge("m", "a", "Q", 0.4)], [Rule("r", ["P", "Q"])])
    assert sorted((r["source"], r["target"], round(r["confidence"], 3)) for r in reasoning.infer(g, "r").collect()) == [("a", "a", 0.36), ("a", "z", 0.45)]
    assert reasoning.infer(g, "unknown").count() == 0


def test_contradictions_name_the_smallest_key(spark):
    g = graph(spark, [node("a", props={"x": 1, "y": 2}), node("b", props={"x": 3, "y": 4}), node("c", "U", {"x": 9})])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a")], "a string, b string")
    assert [tuple(r) for r in reasoning.contradictions(pairs, g.nodes).collect()] == [("a", "b", "differ_on:x")]


def test_similarity_filters_after_the_top(spark):
    g = graph(spark, [node("a", embedding=[1.0, 0.0]), node("b", embedding=[1.0, 0.1], deprecated=True), node("c", embedding=[0.0, 1.0]), node("d", embedding=[0.0, 0.0])])
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r["id"] for r in retrieval.select_approx(g, q, 1).df.collect()] == ["a"]
    assert [r["id"] for r in retrieval.select_approx(g, q, 5, -1.0).df.collect()] == ["a", "c", "d"]
    assert reasoning.check_coverage(g, q, 20, 0.99).first()["verdict"] == "SPARSE"
    assert reasoning.check_coverage(g, q, 20, 2.0).first()["gap"] == "no_matches_above_threshold:2.0"


def test_versions_and_tombstones(spark):
    g = graph(spark, [node("a"), node("b")])
    two = storage.update_nodes(g.nodes, g.nodes.where("id = 'a'").select("id", F.lit("new").alias("label")), NOW)
    rows = g.nodes.unionByName(two)
    rows = rows.unionByName(storage.deprecate(storage.latest(rows), g.nodes.where("id = 'a'")))
    assert sorted((r["id"], r["label"], r["version"], r["deprecated"]) for r in storage.latest(rows).collect()) == [("a", "new", 2, True), ("b", "B", 1, False)]
    assert storage.duplicates(g.nodes, g.nodes.where("id = 'a'")).count() == 1


def test_conversation_turns(spark):
    t = spark.createDataFrame([("1", "s", 0, "user", " a  b "), ("2", "s", 1, "assistant", "x"), ("3", "s", 2, "user", "")], "id string, session_id string, turn_index long, role string, text string")
    assert [r[0] for r in t.select(conversations.token_count(F.col("text"))).collect()] == [2, 1, 0]
    assert {tuple(r) for r in conversations.follows(t).collect()} == {("2", "1"), ("3", "2")}
    assert [r["id"] for r in conversations.recent_turns(t, 2).collect()] == ["2", "3"]
    new = spark.createDataFrame([("s", 0, "user", "q"), ("s", 0, "assistant", "r"), ("s", 1, "user", "  "), ("n", 0, "user", "z")], "session_id string, seq long, role string, text string")
    assert sorted((r["session_id"], r["turn_index"], r["role"]) for r in conversations.assign_turns(t, new).collect()) == [("n", 0, "user"), ("s", 3, "user"), ("s", 4, "assistant")]
    long = t.limit(1).withColumn("text", F.repeat(F.lit("x"), 700)).withColumn("timestamp", F.lit("2024-01-31T10:00:00.5"))
    assert long.select(conversations.rendered(True)).first()[0] == "[turn 0 | user | session:s | 2024-01-31 10:00:00]\n" + "x" * 600 + "…"


def test_event_reading(spark):
    later = lambda h: NOW - timedelta(hours=h)
    g = graph(spark, [node("e", "EVENT_LOG", "{bad", at=later(1)), node("l1", "INTERRUPT_L1", {"resolved": True}), node("l2", "INTERRUPT_L2", {"pattern": "p", "salience_score": 0.4}), node("l3", "INTERRUPT_L3", {"monitor": "m"}), node("old", "INTERRUPT_L2", {"salience_score": 0.9}, at=later(30))])
    assert events.recent_events(g, "EVENT_LOG").first()["properties"] == "{}"
    assert {r["id"] for r in events.active_interrupts(g).collect()} == {"l3", "old"}
    assert [tuple(r) for r in events.pattern_frequency(g, NOW, 48).collect()] == [("p", 1), ("unknown", 1)]
    assert tuple(events.event_summary(g, NOW, 24).first()) == (1, 4, "p", 1)


def test_plans(spark, web):
    steps = [Step("s1", "SELECT_BY_ID", {"id": "a"}, "$a"), Step("s2", "TRAVERSE", {"node": "$a", "rel": "R"}, "$b", depends_on=["s1"]), Step("s3", "ASSERT", {"claim": "c", "sources": "$b", "confidence_threshold": 0.5}, "$c", depends_on=["s2"])]
    ok = Executor(web, NOW).run(Plan(steps, timeout_ms=600_000))
    assert ok.status == "COMPLETE" and len(ok.assertions) == 1 and [t["op"] for t in ok.trace] == ["SELECT_BY_ID", "TRAVERSE", "ASSERT"]
    assert "[A1] Claim: c" in synthesize(web, ok, "q") and verify(web, ok, NOW).first()["completeness"]
    assert Executor(web, NOW).run(Plan([Step("s1", "SELECT_BY_ID", {"id": "zz"}, "$a"), *steps[1:]], timeout_ms=600_000)).status == "PARTIAL"
    assert Executor(web, NOW).run(Plan([Step("s1", "AGGREGATE", {"input": None, "fn": "bad", "prop": "x"}, "$a")])).status == "FAILED"
    assert Executor(web, NOW).run(Plan(steps, timeout_ms=-1)).status == "TIMEOUT"
    none = Executor(web, NOW).run(default_plan("anything"))
    assert none.status == "PARTIAL" and synthesize(web, none, "q") == "[UNKNOWN: no_assertions_for_query: q]"


def test_plan_checks():
    assert validate(default_plan("q"), DEFAULT_SCHEMA) == []
    bad = Plan([Step("a", "SELECT_EXACT", {"type": "NOPE"}, "x", depends_on=["z"]), Step("a", "TRAVERSE", {}, "$t"), Step("b", "WHAT", {}, "$w")], synthesis={"inputs": ["$q"]})
    assert validate(bad, DEFAULT_SCHEMA) == ["binding_must_start_with_$:a", "forward_dependency:a->z", "unknown_type_in_select:NOPE@a", "duplicate_step_id:a", "traverse_missing_rel:a", "unknown_op:WHAT@b", "missing_terminal_assert", "synthesis_input_not_bound:$q"]
    with pytest.raises(ValueError, match="circular_dependency:a"):
        ordered([Step("z", "COUNT"), Step("a", "COUNT", depends_on=["b"]), Step("b", "COUNT", depends_on=["a"])])
    chain = [Step(str(i), "COUNT", depends_on=[str(i + 1)]) for i in range(5000)]
    assert [s.step_id for s in ordered(chain)] == [str(i) for i in reversed(range(5000))]
    loose = Plan([Step("a", "AGGREGATE", {"input": "$z"}, "$a"), Step("b", "CHECK_TYPE", {"node": "$a", "type": "NOPE"}, "$b"), Step("c", "ASSERT", {"claim": "c", "sources": "$b"}, "$c")])
    assert validate(loose, DEFAULT_SCHEMA) == []
    assert validate(loose, DEFAULT_SCHEMA, strict=True) == ["missing_argument_fn:a", "missing_argument_prop:a", "unbound_argument:$z@a", "unknown_type:NOPE@b"]
    assert Plan.from_text('text ```json\n{"steps": [{"step_id": "s", "op": "COUNT"}]}\n``` more').steps[0].op == "COUNT"
    assert resolve({"a": ["$x", "y"], "b": "$z"}, {"$x": 1}) == {"a": [1, "y"], "b": None}


def test_plans_in_a_table_are_checked_and_ordered_as_single_ones(spark):
    import itertools
    import json

    from graphloom.plans import catalog

    pool = [("a", "SELECT_EXACT", {"type": "NOPE"}, "x", ["z"]), ("a", "TRAVERSE", {}, "$t", []), ("b", "WHAT", {}, "$w", ["a"]), ("c", "ASSERT", {"claim": "c"}, "$q", ["a", "c"]), ("d", "TRAVERSE", {"rel": "R"}, "$d", ["c"])]
    specs = [{"steps": [dict(zip(("step_id", "op", "args", "output_binding", "depends_on"), s)) for s in some], "synthesis": {"inputs": i}} for n in range(4) for some in itertools.permutations(pool, n) for i in ([], ["$q", "$n"])]
    rows = spark.createDataFrame([(k, "plan: " + json.dumps(s)) for k, s in enumerate(specs)] + [(-1, "none"), (-2, None)], "k int, text string")
    for r in catalog.in_order(catalog.problems(catalog.parsed(rows), DEFAULT_SCHEMA)).collect():
        plan = Plan.from_dict(specs[r["k"]] if r["k"] >= 0 else {})
        assert r["problems"] == validate(plan, DEFAULT_SCHEMA)
        if len({s.step_id for s in plan.steps}) == len(plan.steps):
            try:
                assert r["order"] == [s.step_id for s in ordered(plan.steps)] and r["circular"] is None
            except ValueError as e:
                assert str(e) == f"circular_dependency:{r['circular']}"


def test_schema_rules(spark):
    s = DEFAULT_SCHEMA
    assert s.relation_allowed("CODE_FILE", "IMPORTS", "CODE_FILE") and not s.relation_allowed("CODE_FILE", "IMPORTS", "FUNCTION")
    assert s.relation_allowed("CODE_FILE", "DEFINES", "FUNCTION") and s.relation_allowed("DOC", "REFERS_TO", "RULE")
    assert s.node_errors("CODE_FILE", {"path": "a", "language": "python"}) == [] and s.node_errors("CODE_FILE", {"path": "a"}) == ["missing_property:language"]
    g = graph(spark, [node("a", "CODE_FILE", {"path": "p", "language": "cobol"}), node("b", "NOPE"), node("c", "CONFIG", {"path": "x"})])
    assert sorted(tuple(r) for r in node_violations(g.nodes, s).collect()) == [("a", "bad_enum:language=cobol"), ("b", "unknown_type:NOPE")]


def test_meta(spark, web):
    assert meta.get_type(one(web, "a")).first()["type_id"] == "T"
    assert meta.get_provenance(web, one(web, "a")).first()["source_uri"] == "/p"
    asked = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert {tuple(r) for r in meta.is_fresh(web, asked, timedelta(0), NOW).collect()} == {("a", True), ("zz", False)}


def test_splits_are_exact(spark):
    parts = {r["part"]: r["count"] for r in dataset.split(spark.range(101), "id", 1).groupBy("part").count().collect()}
    assert parts == {"train": 70, "val": 15, "test": 16}


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_property_and_id_filters_reach_the_scan(spark):
    from graphloom.sources.tables import load

    g = load(spark, "/root/testdata/sf0.001", ["CUSTOMER"])
    plan = scan_of(retrieval.select_exact(g, "CUSTOMER", "c_mktsegment", "BUILDING").df.select("id"))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_acctbal" not in plan.split("ReadSchema")[1]
    assert "EqualTo(c_custkey,17)" in scan_of(retrieval.select_by_id(g, "customer:17").df)
    assert retrieval.select_by_id(g, "customer:017").df.count() == 0 and retrieval.select_by_id(g, "other:1").df.count() == 0
    same = lambda name, value: (got(retrieval.select_exact(g, "CUSTOMER", name, value)), got(Nodes(replace(g, sources={}).live.where(equals(F.col("properties"), name, value)))))
    for name, value in (("c_nationkey", 7), ("c_nationkey", 7.0), ("c_nationkey", 7.5), ("c_nationkey", "7"), ("c_nationkey", True), ("c_name", 1), ("c_mktsegment", "FURNITURE"), ("none", 1), ("c_name", None)):
        a, b = same(name, value)
        assert a == b, (name, value)


def test_set_property_keeps_kinds(spark):
    rows = [node("a", props={"arc_confidence": 0.8, "resolved": True, "tags": ["a", 1], "none": None, "status": "x"}), node("b", props="broken"), node("c", props={})]
    out = {r["id"]: r for r in events.set_property(spark.createDataFrame(rows, NODE_COLUMNS), "status", F.lit("done"), NOW + timedelta(1)).collect()}
    assert json.loads(out["a"]["properties"]) == {"arc_confidence": 0.8, "resolved": True, "tags": ["a", 1], "none": None, "status": "done"}
    assert json.loads(out["b"]["properties"]) == json.loads(out["c"]["properties"]) == {"status": "done"}
    assert {(r["version"], r["updated_at"]) for r in out.values()} == {(2, NOW + timedelta(1))}


def test_time_limit_ends_a_plan(spark, web):
    import time

    from pyspark.sql.types import LongType

    slow = F.udf(lambda x: time.sleep(30) or x, LongType())
    g = replace(web, nodes=web.nodes.withColumn("version", slow(F.col("version").cast("long")).cast("int")).where("version is not null"))
    steps = [{"step_id": "s", "op": "SELECT_BY_ID", "args": {"id": "a"}, "output_binding": "$a"}]
    began = time.monotonic()
    assert Executor(g, NOW).run(Plan.from_dict({"steps": steps, "constraints": {"timeout_ms": 1500}})).status == "TIMEOUT"
    assert time.monotonic() - began < 20
    assert spark.range(3).count() == 3  # later jobs aren't of the group


def test_steps_wait_for_one_job(spark, web):
    steps = [{"step_id": str(i), "op": "SELECT_BY_ID", "args": {"id": "a"}, "output_binding": f"${i}"} for i in range(3)] + [{"step_id": "c", "op": "ASSERT", "args": {"claim": "c", "sources": "$1", "confidence_threshold": 0.1}, "output_binding": "$c", "depends_on": ["1"]}]
    r = Executor(web, NOW).run(Plan.from_dict({"steps": steps, "constraints": {"timeout_ms": 600_000}}))
    assert r.status == "COMPLETE" and [t["summary"] for t in r.trace] == ["ok"] * 4 and len(r.assertions) == 1
    rows = r.trace_rows(spark).collect()
    assert [(x["step_id"], x["op"]) for x in rows] == [("0", "SELECT_BY_ID"), ("1", "SELECT_BY_ID"), ("2", "SELECT_BY_ID"), ("c", "ASSERT")]
    nodes = Executor(web, NOW).run(Plan.from_dict({"steps": [{"step_id": "g", "op": "SUBGRAPH", "args": {"root": "a"}, "output_binding": "$g"}], "constraints": {"timeout_ms": 600_000}})).bindings
    assert nodes["$g.edges"].count() > 0


def test_last_hop_paths(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "t"), ("c", "t"), ("b", "d"), ("d", "t"), ("d", "e"), ("e", "f"), ("f", "t")]
    g = graph(spark, [node(i) for i in "abcdeft"], [edge(*e) for e in edges])
    paths = lambda **a: sorted("".join(r["path"]) for r in navigation.path_find(g, "a", "t", **a).collect())
    assert paths() == ["abt", "act"] and paths(mode="last_hop") == ["abdt", "abt", "act"] and paths(mode="last_hop", max_hops=2) == ["abt", "act"]
    assert sorted(r["path"] for r in navigation.path_find(g, "t", "a", mode="last_hop").collect()) == []


def test_nearest_blocks_match_brute_force(spark):
    import random

    from graphloom.functions import vector

    rng = random.Random(3)
    rows = [(f"v{i}", rng.randrange(9), [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, seq long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    older = {(a[0], b[0]) for a in rows for b in sorted([b for b in rows if (b[1], b[0]) < (a[1], a[0]) and cos(a[2], b[2]) >= 0.3], key=lambda b: (-cos(a[2], b[2]), b[0]))[:3]}
    assert {(r["id"], r["older"]) for r in vector.nearest_older(df, 3, 0.3, block=7).collect()} == older
    near = {(a[0], b[0]) for a in rows[:20] for b in sorted([b for b in rows if cos(a[2], b[2]) >= 0.3], key=lambda b: (-cos(a[2], b[2]), b[0]))[:3]}
    assert {(r["id"], r["other"]) for r in vector.nearest_of(df.where("substring(id, 2) < 20 and length(id) < 4").where(F.substring("id", 2, 9).cast("int") < 20), df, 3, 0.3, block=7).collect()} == near


def test_vector_index_life_cycle(spark, tmp_path):
    import random
    import shutil

    from graphloom.operators.vectors import VectorIndex

    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    vectors = {f"n{i}": [x + rng.gauss(0, 0.2) for x in base[i % 9]] for i in range(300)} | {"zero": [0.0] * 6}
    g = graph(spark, [node(i, embedding=v, deprecated=i == "n7") for i, v in vectors.items()])
    index = VectorIndex(spark, f"file://{tmp_path}/index", 6)
    assert index.version() == 0 and index.load().count() == 0 and index.query([1.0] * 6, 3).count() == 0
    index.add(g.nodes.where("length(id) < 4"))
    files = {p.name for p in (tmp_path / "index").rglob("*.parquet")}
    index.add(g.nodes)
    index.add(g.nodes.withColumn("embedding", F.array(*[F.lit(0.0)] * 6)))
    assert files <= {p.name for p in (tmp_path / "index").rglob("*.parquet")}  # nothing is rewritten
    assert index.version() == 1 and index.load().count() == index.load().select("id").distinct().count() == 301  # ids are added once
    every = lambda v, k: [(r["id"], round(r["score"], 9)) for r in retrieval.nearest(g, F.array(*map(F.lit, v)), k).collect()]
    for v in (vectors["n1"], [-x for x in vectors["n2"]], vectors["zero"]):
        for k in (1, 5, 400):
            assert [(r["id"], round(r["score"], 9)) for r in index.query(v, k, exact=True).collect()] == every(v, k)
    found = index.search(vectors["n1"], 5, exact=True)
    assert found.total == 301 and found.vectors < 150  # the bounds leave far cells unread
    near = index.search(vectors["n1"], 5, share=0.1)
    assert [r["id"] for r in near.hits.collect()] == [i for i, _ in every(vectors["n1"], 5)] and near.codes < 90 and near.vectors <= 40
    segment = next(p for p in (tmp_path / "index/g1/vectors").iterdir() if p.is_dir())
    shutil.copytree(segment, segment.with_name("segment=lost"))  # an add that was lost on the way
    assert index.load().count() == 301
    (tmp_path / "index" / "g2").mkdir()  # a rebuild that was lost
    assert index.version() == 1
    g.index = index
    through = retrieval.select_approx(g, F.array(*map(F.lit, vectors["n1"])), 4, 0.3)
    assert [r["id"] for r in through.df.orderBy(*through.sort).collect()] == [i for i, _ in every(vectors["n1"], 12) if i != "n7"][:4]
    index.root += "-new"
    index.rebuild(g)
    assert index.load().count() == 300 and index.version() == 1


def test_stored_edges_are_walked_alike(spark, tmp_path, monkeypatch):
    """Navigation over bucketed tables: the same results from few nodes and from many, and edges that aren't shuffled."""
    import random

    from graphloom.operators.adjacency import Adjacency

    rng = random.Random(8)
    nodes = [f"v{i}" for i in range(60)]
    made = [edge(*rng.sample(nodes, 2), rng.choice("RS"), nth=k, deprecated=rng.random() < 0.1) for k in range(150)]
    g = graph(spark, [node(i) for i in nodes], made)
    stored = replace(g, adjacency=Adjacency.store(g.edges, "walked_alike", f"file://{tmp_path}/a", 4))
    seeds = lambda x: retrieval.select_by_id(x, "v1")

    def told(x):
        paths = [sorted(map(str, navigation.path_find(x, "v1", t, mode=m).collect())) for t, m in (("v2", "shortest"), ("v30", "shortest"), ("v30", "last_hop"), ("none", "shortest"))]
        near = [sorted(r["id"] for r in navigation.expand(x, seeds(x), rel, 2, way).df.collect()) for rel, way in ((None, "out"), (["R"], "in"))]
        return paths, near, sorted(r["id"] for r in navigation.traverse(x, seeds(x), "R", "both").df.collect()), sorted(r["id"] for r in navigation.subgraph(x, "v1")[1].collect())

    plain = told(g)
    assert any(plain[0][0]) and told(stored) == plain
    monkeypatch.setattr(navigation, "FEW", 0)
    assert told(stored) == plain
    monkeypatch.setattr(navigation, "SMALL_FRONTIER", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = navigation.Level.of(spark.range(50).select(F.concat(F.lit("v"), "id").alias("id"))).edges(stored, None, "out")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    edges, frontier = sorted(plan.split("SortMergeJoin")[1].split("Sort ")[1:], key=lambda side: "Exchange" in side)
    assert "Exchange" not in edges and "Bucketed: true" in edges and "Exchange" in frontier
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        parts = [stored.adjacency.edges("out", None, ids).rdd.getNumPartitions() for ids in (None, ["v1"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts[1] <= parts[0] / 3  # the bucket of v1 alone is read


def test_a_hubs_edges_are_numbered_in_pieces(spark, monkeypatch):
    from graphloom.operators import dataset

    monkeypatch.setattr(dataset, "NUMBERED", 50)
    edges = spark.range(1000).select(F.when(F.col("id") < 900, "hub").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"), F.col("id").cast("string").alias("target"), F.lit("R").alias("relation"), F.concat(F.lit("e"), "id").alias("edge"))
    numbered, degrees = dataset.numbered_edges(edges)
    got: dict = {}
    for r in numbered.collect():
        got.setdefault(r["source"], []).append(r["nth"])
    assert {s: len(n) for s, n in got.items()} == {r["source"]: r["degree"] for r in degrees.collect()} and len(got) == 11
    assert all(sorted(n) == list(range(len(n))) for n in got.values())

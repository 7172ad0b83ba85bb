"""A project and a conversation through the stored graph."""

from datetime import datetime

from pyspark.sql import functions as F

from graphloom.functions.vector import turn_embedding
from graphloom.operators import conversations, events, retrieval
from graphloom.workspace import Workspace

NOW = datetime(2024, 1, 31)
PROJECT = {"main.py": "import utils\nimport config\n\ndef main(): pass\n\ndef helper_main(): pass\n", "utils.py": "def helper(): pass\n\ndef other(): pass\n", "config.py": "VALUE = 1\n\ndef get_value(): return VALUE\n", "README.md": "# T\n", "settings.json": "{}"}


def test_end_to_end(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, text in PROJECT.items():
        (tmp_path / "src" / name).write_text(text)
    w = Workspace(spark, str(tmp_path / "graph"), create=True)
    w.ingest(str(tmp_path / "src"), NOW)
    stats = {r["type_id"]: r["n"] for r in w.stats().collect()}
    assert (stats["CODE_FILE"], stats["DOC"], stats["CONFIG"], stats["FUNCTION"], stats["SESSION"]) == (3, 1, 1, 5, 0)
    kinds = {r["type_id"]: r["count"] for r in w.graph.edges.groupBy("type_id").count().collect()}
    assert kinds["DEFINES"] == 5 and kinds["IMPORTS"] == 2
    w.ingest(str(tmp_path / "src"), NOW)
    assert {r["version"] for r in w.graph.nodes.collect()} == {2} and w.graph.edges.where("type_id = 'IMPORTS'").count() == 2

    turns = spark.createDataFrame([("s", 0, "user", "hello there"), ("s", 1, "assistant", "hi")], "session_id string, turn_index long, role string, text string")
    w.converse(turns, NOW)
    w.converse(turns, NOW)
    assert {r["type_id"]: r["count"] for r in w.graph.edges.where("type_id in ('PART_OF', 'FOLLOWS')").groupBy("type_id").count().collect()} == {"PART_OF": 2, "FOLLOWS": 1}
    answer = w.query("what files exist in the project?", NOW)
    assert answer["status"] in ("COMPLETE", "PARTIAL") and answer["text"]
    assert w.query('{"steps": [{"step_id": "s", "op": "NOPE"}]}', NOW)["status"] == "FAILED"
    assert w.assert_claim("files", ["file:main.py"]).first()["unknown_reason"] is None


def test_conversations_are_embedded_and_refer(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "graph"), create=True)
    said, bare = "where is the parser?", w.graph.nodes.columns
    at = F.lit(NOW).cast("timestamp_ntz")
    for id, type_id, old in (("doc", "DOC", False), ("gone", "DOC", True), ("guess", "INFERRED", False)):
        node = events.record(spark.range(1), type_id, {"x": F.lit(1)}, F.lit(id), at).withColumns({"embedding": retrieval.embed(said), "deprecated": F.lit(old)})
        w.store.add("nodes", node.select(*bare))
    turns = spark.createDataFrame([("s", 0, "user", said), ("s", 1, "assistant", "in parser.py"), ("t", 0, "user", said)], "session_id string, turn_index long, role string, text string")
    for _ in range(2):
        w.converse(turns, NOW)
    found = w.graph.edges.where("type_id = 'REFERENCES'").select("source", "target", "weight", "confidence").collect()
    refs = conversations.references(w.graph, retrieval.embed(said)).collect()
    assert [r["id"] for r in refs] == ["doc"]
    assert sorted(map(tuple, found)) == [("turn:s:0:user", "doc", 0.8, 0.8), ("turn:t:0:user", "doc", 0.8, 0.8)]
    assert w.graph.nodes.where("type_id in ('CONVERSATION_TURN', 'SESSION') and embedding is null").count() == 0
    like = turn_embedding(F.lit("user"), F.lit(said))
    assert [r["id"] for r in conversations.semantic_turns(w.graph, like, "s").collect()] == ["turn:t:0:user"]


def test_generations(spark, tmp_path):
    """Compacted rows that later ones don't touch aren't ranked; what was lost on the way doesn't count."""
    from graphloom.model import NODE_COLUMNS
    from graphloom.sources.store import GraphStore

    row = lambda i, version, deprecated=False, kind="DOC": (i, kind, i, None, "{}", None, 0.9, version, NOW, NOW, None, deprecated, "p")
    rows = lambda *r: spark.createDataFrame(list(r), NODE_COLUMNS)
    told = lambda: {(r["id"], r["version"], r["deprecated"]) for r in store.current("nodes").collect()}
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert told() == set() and store.read("edges").count() == 0
    store.add("nodes", rows(*(row(f"n{i}", 1, kind="DOC" if i % 2 else "RULE") for i in range(40))))
    store.add("nodes", rows(row("n1", 2)))
    before = told()
    store.compact("nodes")
    assert store.generation("nodes") == 1 and told() == before == {(f"n{i}", 1 + (i == 1), False) for i in range(40)}
    store.add("nodes", rows(row("n1", 3), row("n2", 1, True), row("new", 1)))
    store.add("nodes", rows(row("n3", 0)))  # older than what is compacted
    assert told() == (before - {("n1", 2, False), ("n2", 1, False)}) | {("n1", 3, False), ("n2", 1, True), ("new", 1, False)}
    plan = store.current("nodes")._jdf.queryExecution().optimizedPlan().toString()
    untouched, ranked = plan[: plan.index("Window")], plan[plan.index("Window") :]
    assert "LeftAnti" in untouched and "LeftSemi" in ranked
    (tmp_path / "g/nodes/base/g2").mkdir()  # a compaction that was lost
    assert store.generation("nodes") == 1 and store.read("nodes").count() == 45
    (tmp_path / "g/nodes/base/g2").rmdir()
    store.compact("nodes")
    assert store.generation("nodes") == 2 and ("n1", 3, False) in told() and len(told()) == 41

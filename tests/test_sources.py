"""Files and transcripts as graph tables; streaming forms."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphloom.sources import files as src
from graphloom.sources import transcripts
from graphloom.sources.jsonl import write_pairs
from graphloom.streaming import turns
from graphloom.streaming.events import new_turns, pattern_counts, run_once

PROJECT = {
    "main.py": "import utils\nimport config\n\ndef main():\n    pass\n\nasync def helper_main():\n    pass\n", "utils.py": "def helper():\n    def inner(): pass\n\ndef other(): pass\n",
    "config.py": "VALUE = 1\n\ndef get_value():\n    return VALUE\n", "broken.py": "def (", "README.md": "# Title\n\nText\n", "settings.json": '{"name": "fixture"}', "node_modules/x.js": "1", "pkg/deep.py": "from a import b\nfrom . import c\n", "image.png": "no",
}


def test_project(spark, tmp_path):
    for name, text in PROJECT.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = src.read_files(spark, str(tmp_path)).cache()
    assert sorted(r["path"] for r in files.collect()) == ["README.md", "broken.py", "config.py", "main.py", "pkg/deep.py", "settings.json", "utils.py"]
    nodes = {r["label"]: r for r in src.file_nodes(files).collect()}
    assert json.loads(nodes["main.py"]["properties"]) == {"path": "main.py", "language": "python", "line_count": 9, "module": "main"}
    assert json.loads(nodes["settings.json"]["properties"]) == {"path": "settings.json", "key": "settings"} and len(nodes["README.md"]["embedding"]) == 384
    symbols = src.python_symbols(files).cache()
    assert sorted(r["label"] for r in src.function_nodes(symbols).collect()) == ["get_value", "helper", "helper_main", "inner", "main", "other"]
    assert src.defines(symbols).count() == 6
    assert {(r["source"], r["target"]) for r in src.imports(symbols, files).collect()} == {("file:main.py", "file:utils.py"), ("file:main.py", "file:config.py")}
    assert src.contents(files).where("hash is not null").count() == 7
    assert src.read_files(spark, str(tmp_path / "main.py")).first()["path"] == "main.py"


def test_import_falls_back_to_an_ending(spark):
    files = spark.createDataFrame([("lib/myutils.py", "python"), ("z/utils.py", "python"), ("m.py", "python")], "path string, language string")
    symbols = spark.createDataFrame([("m.py", "import", "pkg.utils"), ("m.py", "import", "nothing")], "path string, kind string, name string")
    assert [(r["source"], r["target"]) for r in src.imports(symbols, files).collect()] == [("file:m.py", "file:lib/myutils.py")]


def test_similarity_links_go_to_older_nodes(spark):
    rows = [("a", datetime(2024, 1, 1), [1.0, 0.0]), ("b", datetime(2024, 1, 2), [1.0, 0.01]), ("c", datetime(2024, 1, 2), [0.99, 0.0]), ("d", datetime(2024, 1, 3), [0.0, 1.0])]
    n = spark.createDataFrame(rows, "id string, created_at timestamp_ntz, embedding array<float>")
    assert {(r["source"], r["target"]) for r in src.similar_to(n).collect()} == {("b", "a"), ("c", "a"), ("c", "b")}
    assert {(r["source"], r["target"]) for r in src.similar_to(n, k=1).collect()} == {("b", "a"), ("c", "a")}


def test_json_lines(spark, tmp_path):
    pairs = spark.createDataFrame([('what is "x"?', '{"steps":[]}')], "query string, plan string")
    write_pairs(pairs, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"query": 'what is "x"?', "plan": {"steps": []}}


def test_transcripts(spark, tmp_path):
    """Text, blocks, messages as text, what is broken or blank, and the counters."""
    long = "x" * 3000
    lines = [
        {"type": "user", "message": {"role": "user", "content": "  hi\n"}}, {"type": "user", "message": {"content": [{"type": "text", "text": "two"}, {"type": "image"}, 7, None, "x", {"type": "text", "text": "parts"}, {"type": "text"}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "text": "no"}]}}, {"type": "user", "message": "no object"}, {"type": "user", "message": [1]}, {"type": "user"}, [1, 2], "x",
        {"type": "assistant", "message": json.dumps({"role": "assistant", "content": "as text", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 85, "cache_creation_input_tokens": None}})},
        {"type": "assistant", "message": {"role": "assistant", "content": None, "usage": {"input_tokens": 0}}}, {"type": "summary", "message": {"content": 12}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"type":"user","message":{"content":"cut\n\n')
    (tmp_path / "b.jsonl").write_text(json.dumps({"type": "user", "message": {"role": "user", "content": long}}))
    m = transcripts.read_messages(spark, str(tmp_path))
    last = {(r["file"][-7:], r["kind"]): r["text"] for r in transcripts.last_messages(m).collect()}
    assert last == {("a.jsonl", "user"): "two parts", ("a.jsonl", "assistant"): "as text", ("a.jsonl", "summary"): "12", ("b.jsonl", "user"): long[:2000]}
    assert {r["file"][-7:]: r["percent"] for r in transcripts.context_in_use(m, 300).collect()} == {"a.jsonl": 33, "b.jsonl": 0}


def test_transcripts_in_pieces(spark, tmp_path):
    """A file that several tasks read keeps the order of its lines."""
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"type": "user", "message": {"content": f"message {i} " + "y" * 200}}) + "\n" for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        m = transcripts.read_messages(spark, str(tmp_path))
        assert m.rdd.getNumPartitions() > 3
        assert [r["text"].split()[1] for r in m.orderBy("seq").collect()] == [str(i) for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_written_transcripts_are_read_back(spark, tmp_path):
    said = [("s1", 0, "user", 'a "b"\n'), ("s1", 1, "assistant", "c"), ("s2", 0, "user", "d")]
    df = spark.createDataFrame(said, "session_id string, turn_index long, role string, text string").withColumn("usage", F.when(F.col("role") == "assistant", F.struct(F.lit(9).alias("input_tokens"))))
    transcripts.write_transcripts(df.repartition(3), str(tmp_path / "t"))
    m = transcripts.read_messages(spark, str(tmp_path / "t"))
    assert sorted((r["role"], r["text"], r["tokens"]) for r in m.collect()) == [("assistant", "c", 9), ("user", 'a "b"', 0), ("user", "d", 0)]


def test_turns_are_numbered_across_restarts(spark, tmp_path):
    at = lambda hours: datetime(2024, 1, 1) + timedelta(hours=hours)
    folder = lambda name: f"{tmp_path}/{name}"

    def say(*rows):
        spark.createDataFrame(rows, turns.MESSAGES).coalesce(1).write.mode("append").parquet(folder("messages"))
        turns.ingest(spark, folder("messages"), folder("turns"), folder("checkpoint"), idle="2 hours", delay="1 hour")

    say(("a", 2, "assistant", "two", at(0)), ("a", 1, "user", "one", at(0)), ("a", 1, "user", "one", at(0)), ("b", 1, "user", " ", at(0)), (None, 1, "user", "x", at(0)))
    say(("a", 2, "assistant", "two", at(0)), ("a", 3, "user", "three", at(1)), ("b", 2, "user", "first", at(1)))
    say(("c", 1, "user", "much later", at(9)))
    say(("a", 1, "user", "again", at(9)))  # its session is forgotten by then
    got = spark.read.schema(turns.TURNS).parquet(folder("turns")).collect()
    assert sorted((r["id"], r["previous"] or "", r["text"], r["opens"]) for r in got) == [
        ("turn:a:0", "", "again", True), ("turn:a:0", "", "one", True), ("turn:a:1", "turn:a:0", "two", False), ("turn:a:2", "turn:a:1", "three", False), ("turn:b:0", "", "first", True), ("turn:c:0", "", "much later", True),
    ]


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 5), "a", "s", 0, "user"), (datetime(2024, 1, 1, 0, 6), "a", "s", 0, "user"), (datetime(2024, 1, 1, 1, 5), "b", "s", 1, "user"), (datetime(2024, 1, 2), "c", "s", 2, "user")]
    table = spark.createDataFrame(rows, "ts timestamp, event_type string, session_id string, turn_index long, role string")
    table.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    run_once(pattern_counts(stream()), str(tmp_path / "counts"), str(tmp_path / "c1"))
    assert {("a", 2), ("b", 1)} <= {(r["pattern"], r["n"]) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    run_once(new_turns(stream().withColumn("at", F.col("ts"))), str(tmp_path / "turns"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "turns")).count() == 3

"""One object for a stored graph: ingest, plan, query, assert, coverage, statistics."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import properties as P
from .functions.vector import hash_embedding, turn_embedding
from .graph import Graph
from .operators import conversations, events, lists, reasoning, retrieval
from .plans.executor import Executor, Result
from .plans.plan import Plan, default_plan, validate
from .plans.verify import synthesize, verify
from .sources import files
from .sources.store import GraphStore


class Workspace:
    """A graph below a folder. Times are given, never read from the clock."""

    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.spark, self.store = spark, GraphStore(spark, root)
        if create:
            self.store.create()

    @property
    def graph(self) -> Graph:
        return self.store.graph()

    def ingest(self, path: str, as_of: datetime, similar: int = 5) -> None:
        """Files below path as nodes, their functions, imports, similarity links, contents and provenance;
        ids come from paths, so ingesting again adds new versions instead of copies."""
        found = files.read_files(self.spark, path)
        symbols = files.python_symbols(found)
        nodes = files.file_nodes(found).unionByName(files.function_nodes(symbols))
        seen = self.store.current("nodes").select("id", F.col("version").alias("seen"))
        self.store.add("nodes", nodes.join(seen, "id", "left").withColumn("version", F.coalesce(F.col("seen") + 1, F.lit(1))))
        self.store.add("contents", files.contents(found))
        self.store.add("provenance", found.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("source_type"), F.col("path").alias("source_uri"), F.lit("files").alias("extracted_by"), F.lit(as_of).alias("extracted_at"), F.lit("trusted").alias("trust_level")))
        self.store.add("uncertainty", files.file_nodes(found).select(F.col("id").alias("node_id"), "confidence", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("freshness_score"), F.lit(as_of).alias("last_verified")))
        live = self.graph.live.where(F.col("type_id").isin("CODE_FILE", "DOC", "CONFIG", "FUNCTION"))
        edges = files.defines(symbols).unionByName(files.imports(symbols, found)).unionByName(files.similar_to(live, similar))
        known = self.store.current("edges").select("id")
        self.store.add("edges", edges.dropDuplicates(["id"]).join(known, "id", "left_anti").withColumns({"directional": F.lit(True), "version": F.lit(1), "created_at": F.lit(as_of)}))

    def converse(self, turns: DataFrame, as_of: datetime) -> None:
        """Turns (session_id, turn_index, role, text, perhaps project) that aren't there yet and their sessions, with
        provenance and uncertainty; PART_OF, FOLLOWS and REFERENCES."""
        g = self.graph
        had = conversations.turns_of(g)
        new = conversations.new_turns(had, turns if "project" in turns.columns else turns.withColumn("project", F.lit("")))
        at = F.lit(as_of).cast("timestamp_ntz")
        stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
        key = F.concat_ws(":", F.lit("turn"), "session_id", F.col("turn_index").cast("string"), "role")
        session = F.concat(F.lit("session:"), F.col("session_id"))
        fields = {c: F.col(c) for c in ("session_id", "turn_index", "role", "text")} | {"timestamp": stamp, "token_count": conversations.token_count(F.col("text"))}
        said = events.record(new, conversations.TURN, fields, key, at, label=conversations.turn_label(), embedding=turn_embedding(F.col("role"), F.col("text")))
        opened = g.nodes.where("type_id = 'SESSION'").select(P.text(F.col("properties"), "session_id").alias("session_id"))
        first = new.groupBy("session_id").agg(F.min(F.coalesce("project", F.lit(""))).alias("project"))
        fields = {"session_id": F.col("session_id"), "project": F.col("project"), "started_at": stamp}
        heads = events.record(conversations.sessions(opened, first, ["project"]), "SESSION", fields, session, at, label=F.col("session_id"), embedding=hash_embedding(F.concat_ws(" ", F.lit("SESSION"), "session_id", "project")))
        named = new.withColumn("id", key)
        chain = conversations.follows(had.select("session_id", "turn_index", "id").unionByName(named.select("session_id", "turn_index", "id"))).join(named.select("id"), "id", "left_semi")
        edges = events.relation(named, F.col("id"), session, "PART_OF", at).unionByName(events.relation(chain, F.col("id"), F.col("previous"), "FOLLOWS", at))
        added = said.unionByName(heads).withColumn("provenance_id", F.concat(F.lit("conversation:"), F.col("id")))
        near = conversations.references_of(g.nodes.select(*added.columns).unionByName(added), named)
        edges = edges.unionByName(events.relation(near, F.col("id"), F.col("target"), "REFERENCES", at, 0.8, 0.8))
        # Written last, as the others are made of what isn't among the nodes yet.
        self.store.add("edges", edges)
        self.store.add("provenance", added.select(F.col("provenance_id").alias("id"), F.lit("human").alias("source_type"), F.col("id").alias("source_uri"), F.lit("conversations").alias("extracted_by"), at.alias("extracted_at"), F.lit("trusted").alias("trust_level")))
        self.store.add("uncertainty", added.select(F.col("id").alias("node_id"), "confidence", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("freshness_score"), at.alias("last_verified")))
        self.store.add("nodes", added)

    def plan(self, text: str) -> Plan:
        """The plan in a text that holds one, else the default plan of the query."""
        return Plan.from_text(text) if "{" in text else default_plan(text)

    def execute(self, plan: Plan, as_of: datetime) -> Result:
        """An invalid plan fails without running."""
        errors = validate(plan, self.store.schema)
        if errors:
            return Result("FAILED", {}, error="invalid_plan: " + ", ".join(errors))
        result = Executor(self.graph, as_of).run(plan)
        if result.assertions:
            rows = [
                a["sources"].df.agg(F.collect_list("id").alias("source_node_ids")).select(F.lit(a["id"]).alias("id"), F.lit(a["claim"]).alias("claim"), "source_node_ids", F.lit(a["confidence"]).alias("confidence"), F.lit(as_of).alias("created_at"), F.lit(a["plan_step_id"]).alias("plan_step_id"))
                for a in result.assertions
            ]  # an assertion's sources are one value of its row, as the model has it
            self.store.add("assertions", reduce(DataFrame.unionByName, rows))
        return result

    def query(self, text: str, as_of: datetime) -> dict:
        """Plan, run, verify and answer in words."""
        result = self.execute(self.plan(text), as_of)
        if result.status == "FAILED":
            return {"status": "FAILED", "text": "[UNKNOWN: invalid_plan]", "error": result.error}
        return {"status": result.status, "text": synthesize(self.graph, result, text), "report": verify(self.graph, result, as_of).first().asDict(), "coverage": self.check_coverage(text).first().asDict()}

    def assert_claim(self, claim: str, ids: list[str], threshold: float = 0.7) -> DataFrame:
        return reasoning.assert_claim(self.graph, claim, self.spark.createDataFrame([(i,) for i in ids], "id string"), threshold)

    def check_coverage(self, topic: str) -> DataFrame:
        return reasoning.check_coverage(self.graph, retrieval.embed(topic))

    def stats(self) -> DataFrame:
        return lists.count_by_type(self.graph)

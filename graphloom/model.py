"""The typed property graph's data model: table schemas, the type registry, relation rules.

Properties are JSON text and stay schema-on-read; the registry says which types,
properties and relations a schema declares, and validation is a query like any other.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

NODE_COLUMNS = "id string, type_id string, label string, embedding array<float>, properties string, content_ref string, confidence double, version int, created_at timestamp_ntz, updated_at timestamp_ntz, valid_until timestamp_ntz, deprecated boolean, provenance_id string"
EDGE_COLUMNS = "id string, source string, target string, type_id string, weight double, confidence double, directional boolean, version int, valid_until timestamp_ntz, deprecated boolean, provenance_id string, created_at timestamp_ntz"
CONTENT_COLUMNS = "id string, format string, data binary, hash string, encoding string, source_uri string, extracted_at timestamp_ntz, chunks array<string>"
PROVENANCE_COLUMNS = "id string, source_type string, source_uri string, extracted_by string, extracted_at timestamp_ntz, raw_content_id string, pipeline_run_id string, trust_level string"
UNCERTAINTY_COLUMNS = "node_id string, confidence double, coverage double, freshness_score double, contradiction_set array<string>, last_verified timestamp_ntz"
ASSERTION_COLUMNS = "id string, claim string, source_node_ids array<string>, confidence double, created_at timestamp_ntz, plan_step_id string"


# Enumerations that stored rows use.
SOURCE_TYPES = ("file", "db_query", "api_call", "inference", "human")
TRUST_LEVELS = ("verified", "trusted", "unverified", "contested")
CONTENT_FORMATS = ("text", "code", "json", "table", "binary")

DEFAULT_CONFIDENCE, DEFAULT_WEIGHT, DEFAULT_VERSION = 0.9, 1.0, 1


@dataclass
class NodeType:
    """properties: name to (kind, required, enum values); relations: name to target type or "*"."""

    extends: str | None = None
    properties: dict[str, tuple[str, bool, tuple[str, ...]]] = field(default_factory=dict)
    relations: dict[str, str] = field(default_factory=dict)


@dataclass
class Rule:
    """A two-step rule: first relation, then second, imply a fact about the far end."""

    rule_id: str
    relations: list[str]


@dataclass
class Schema:
    types: dict[str, NodeType]
    rules: dict[str, Rule] = field(default_factory=dict)

    def lineage(self, type_id: str) -> list[str]:
        """The type and its ancestors, nearest first."""
        out: list[str] = []
        while type_id in self.types and type_id not in out:
            out.append(type_id)
            type_id = self.types[type_id].extends or ""
        return out

    def properties(self, type_id: str) -> dict[str, tuple[str, bool, tuple[str, ...]]]:
        out: dict = {}
        for t in reversed(self.lineage(type_id)):
            out |= self.types[t].properties
        return out

    def relation_allowed(self, source_type: str, relation: str, target_type: str) -> bool:
        for t in self.lineage(source_type):
            if relation in self.types[t].relations:
                target = self.types[t].relations[relation]
                return target == "*" or target in self.lineage(target_type)
        return False

    def relation_rows(self) -> list[tuple[str, str, str]]:
        """(source type, relation, target type or "*"), inheritance spelled out."""
        out = []
        for t in self.types:
            found: dict[str, str] = {}
            for up in reversed(self.lineage(t)):
                found |= self.types[up].relations
            for relation, target in found.items():
                targets = ["*"] if target == "*" else [x for x in self.types if target in self.lineage(x)]
                out += [(t, relation, x) for x in targets]
        return out

    def node_errors(self, type_id: str, properties: dict) -> list[str]:
        if type_id not in self.types:
            return [f"unknown_type:{type_id}"]
        out = []
        for name, (kind, required, values) in self.properties(type_id).items():
            value = properties.get(name)
            if required and value is None:
                out.append(f"missing_property:{name}")
            elif kind == "enum" and value is not None and values and value not in values:
                out.append(f"bad_enum:{name}={value}")
        return out


# The default schema's types, with their properties (kind, required, enum values) and relations.
DEFAULT_SCHEMA = Schema(
    {
        "ENTITY": NodeType(
            None,
            {"name": ("string", False, ())},
            {"REFERS_TO": "*"},
        ),
        "CODE_FILE": NodeType(
            "ENTITY",
            {"path": ("string", True, ()), "module": ("string", False, ()), "language": ("enum", True, ("python", "javascript", "typescript", "bash", "rust", "go", "other",)), "line_count": ("int", False, ())},
            {"IMPORTS": "CODE_FILE", "DEFINES": "FUNCTION", "DEFINES_CLASS": "CLASS", "USES_CONFIG": "CONFIG", "DOCUMENTED_BY": "DOC"},
        ),
        "FUNCTION": NodeType(
            "ENTITY",
            {"name": ("string", True, ()), "signature": ("string", False, ()), "is_async": ("bool", False, ())},
            {"CALLS": "FUNCTION", "USES": "*"},
        ),
        "CLASS": NodeType(
            "ENTITY",
            {"name": ("string", True, ())},
            {"INHERITS": "CLASS", "CONTAINS": "FUNCTION"},
        ),
        "CONFIG": NodeType(
            "ENTITY",
            {"path": ("string", True, ()), "key": ("string", False, ()), "value": ("string", False, ()), "system": ("string", False, ())},
            {"GOVERNS": "CODE_FILE"},
        ),
        "DOC": NodeType(
            "ENTITY",
            {"path": ("string", True, ()), "title": ("string", False, ()), "topic": ("string", False, ())},
            {"DOCUMENTS": "*"},
        ),
        "RULE": NodeType(
            "ENTITY",
            {"name": ("string", True, ()), "threshold": ("float", False, ()), "hard_constraint": ("bool", False, ())},
            {"CONSTRAINS": "*", "ENFORCED_BY": "CODE_FILE"},
        ),
        "METRIC": NodeType(
            "ENTITY",
            {"name": ("string", True, ()), "value": ("float", False, ()), "timestamp": ("string", False, ()), "system": ("string", False, ())},
            {"MEASURED_BY": "CODE_FILE", "VIOLATES": "RULE"},
        ),
        "FACT": NodeType(
            "ENTITY",
            {"statement": ("string", True, ()), "domain": ("string", False, ())},
            {"DERIVED_FROM": "*"},
        ),
        "SESSION": NodeType(
            "ENTITY",
            {"session_id": ("string", True, ()), "started_at": ("string", False, ()), "project": ("string", False, ()), "description": ("string", False, ())},
            {"CONTAINS": "CONVERSATION_TURN"},
        ),
        "CONVERSATION_TURN": NodeType(
            "ENTITY",
            {"session_id": ("string", True, ()), "turn_index": ("int", True, ()), "role": ("enum", True, ("user", "assistant",)), "text": ("string", True, ()), "timestamp": ("string", False, ()), "token_count": ("int", False, ())},
            {"FOLLOWS": "CONVERSATION_TURN", "REFERENCES": "*", "PART_OF": "SESSION"},
        ),
        "CHECKPOINT": NodeType(
            "ENTITY",
            {"session_id": ("string", True, ()), "summary": ("string", True, ()), "project": ("string", False, ()), "timestamp": ("string", False, ())},
            {},
        ),
        "EVENT_LOG": NodeType(
            "ENTITY",
            {"event_type": ("string", True, ()), "source": ("string", True, ()), "session_id": ("string", False, ()), "payload": ("string", False, ()), "timestamp": ("string", True, ())},
            {"INTERRUPT_OF": "EVENT_LOG"},
        ),
        "INTERRUPT_L1": NodeType(
            "ENTITY",
            {"trigger_metric": ("string", True, ()), "trigger_value": ("float", True, ()), "threshold": ("float", True, ()), "action": ("string", True, ()), "session_id": ("string", False, ()), "timestamp": ("string", True, ()), "resolved": ("bool", False, ())},
            {"INTERRUPT_OF": "EVENT_LOG", "EMITTED_BY": "*"},
        ),
        "INTERRUPT_L2": NodeType(
            "ENTITY",
            {"pattern": ("string", True, ()), "salience_score": ("float", True, ()), "action": ("string", True, ()), "session_id": ("string", False, ()), "timestamp": ("string", True, ())},
            {"INTERRUPT_OF": "EVENT_LOG"},
        ),
        "INTERRUPT_L3": NodeType(
            "ENTITY",
            {"monitor": ("string", True, ()), "observation": ("string", True, ()), "action": ("string", True, ()), "arc_triggered": ("bool", False, ()), "session_id": ("string", False, ()), "timestamp": ("string", True, ())},
            {},
        ),
        "ARC_CHALLENGE": NodeType(
            "ENTITY",
            {"target_node_id": ("string", True, ()), "challenge_type": ("enum", True, ("contradiction", "stale", "low_confidence", "incompleteness",)), "evidence": ("string", True, ()), "arc_confidence": ("float", True, ()), "session_id": ("string", False, ()), "timestamp": ("string", True, ()), "ecl_status": ("enum", False, ("pending", "arbitrating", "resolved", "deferred",))},
            {"CHALLENGED_BY": "*", "RESOLVED_TO": "ARBITRATION_OUTCOME"},
        ),
        "ARC_REVISION": NodeType(
            "ENTITY",
            {"original_node_id": ("string", True, ()), "proposed_content": ("string", True, ()), "revision_type": ("enum", True, ("update", "deprecate", "split", "merge",)), "arc_confidence": ("float", True, ()), "status": ("enum", False, ("proposed", "sandbox", "promoted", "rejected",)), "timestamp": ("string", True, ())},
            {"SUPERSEDES": "*", "SANDBOXED_BY": "*"},
        ),
        "ARBITRATION_OUTCOME": NodeType(
            "ENTITY",
            {"outcome": ("enum", True, ("override", "merge", "fork", "sandbox", "defer",)), "challenger_id": ("string", True, ()), "challenged_id": ("string", True, ()), "ecl_confidence": ("float", True, ()), "risk_score": ("float", False, ()), "reason": ("string", True, ()), "session_id": ("string", False, ()), "timestamp": ("string", True, ()), "reeval_after": ("string", False, ())},
            {"FORKED_FROM": "*"},
        ),
    },
    {"transitive_imports": Rule("transitive_imports", ["IMPORTS", "IMPORTS"])},
)


def load_schema(path: str) -> Schema:
    """A schema from its JSON file, or the default one by the name `default`."""
    if path == "default":
        return DEFAULT_SCHEMA
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    types = {}
    for name, t in spec["types"].items():
        properties = {p: (d.get("type", "string"), bool(d.get("required")), tuple(d.get("enum_values") or ())) for p, d in (t.get("properties") or {}).items()}
        relations = {r: d.get("target_type", "*") for r, d in (t.get("relations_out") or {}).items()}
        types[name] = NodeType(t.get("extends"), properties, relations)
    rules = {r["rule_id"]: Rule(r["rule_id"], [s["rel"] for s in r.get("pattern", [])]) for r in spec.get("inference_rules", [])}
    return Schema(types, rules)

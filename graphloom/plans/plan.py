"""The step-plan language: steps, plans, parsing, the operators' signatures, and what follows from them."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from ..model import Schema

HALT, CONTINUE = "HALT", "CONTINUE"

# The operators of the plan language, and of each the arguments it can't do without and what these are:
# nodes (a binding or an id), type, relation, or any other value.
SIGNATURES: dict[str, dict[str, str]] = {
    "SELECT_EXACT": {"type": "type", "property": "value", "value": "value"},
    "SELECT_APPROX": {"query": "value"},
    "SELECT_BY_ID": {"id": "value"},
    "SELECT_FRESH": {"type": "type", "property": "value", "value": "value"},
    "TRAVERSE": {"node": "nodes", "rel": "relation"},
    "EXPAND": {"nodes": "nodes"},
    "PATH_FIND": {"source": "nodes", "target": "nodes"},
    "SUBGRAPH": {"root": "nodes"},
    "INTERSECT": {"a": "nodes", "b": "nodes"},
    "UNION": {"a": "nodes", "b": "nodes"},
    "DIFFERENCE": {"a": "nodes", "b": "nodes"},
    "FILTER": {"input": "nodes", "condition": "value"},
    "RANK": {"input": "nodes"},
    "SORT": {"input": "nodes"},
    "TOP_K": {"input": "nodes"},
    "COUNT": {"input": "nodes"},
    "AGGREGATE": {"input": "nodes", "fn": "value", "prop": "value"},
    "GROUP": {"input": "nodes"},
    "REDUCE": {"input": "nodes"},
    "ASSERT": {"claim": "value", "sources": "nodes"},
    "INFER": {"rule_id": "value"},
    "CONTRADICT": {"a": "nodes", "b": "nodes"},
    "CHECK_COVERAGE": {"topic": "value"},
    "GET_TYPE": {"node": "nodes"},
    "CHECK_TYPE": {"node": "nodes", "type": "type"},
    "GET_PROVENANCE": {"node": "nodes"},
    "IS_FRESH": {"node": "nodes"},
}
# The arguments that every validation asks for, and what it says where they are missing or undeclared.
MISSING = {("TRAVERSE", "rel"): "traverse_missing_rel"}
UNDECLARED = {("SELECT_EXACT", "type"): "unknown_type_in_select"}


@dataclass
class Step:
    step_id: str
    op: str
    args: dict = field(default_factory=dict)
    output_binding: str = ""
    on_empty: str = HALT
    on_type_error: str = HALT
    depends_on: list[str] = field(default_factory=list)


@dataclass
class Plan:
    steps: list[Step]
    query: str = ""
    timeout_ms: int = 10_000
    synthesis: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, spec: dict) -> Plan:
        known = Step.__dataclass_fields__
        steps = [Step(**{k: v for k, v in s.items() if k in known}) for s in spec.get("steps", [])]
        return cls(steps, spec.get("query", ""), int((spec.get("constraints") or {}).get("timeout_ms", 10_000)), spec.get("synthesis") or {})

    @classmethod
    def from_text(cls, text: str) -> Plan:
        """The JSON object between the first `{` and the last `}`, code fences and prose aside."""
        begin, end = text.find("{"), text.rfind("}")
        if begin < 0 or end < begin:
            raise ValueError("no JSON object in the text")
        return cls.from_dict(json.loads(text[begin : end + 1]))


def default_plan(query: str) -> Plan:
    """Select what resembles the query, and assert it."""
    return Plan([Step("s1", "SELECT_APPROX", {"query": query, "k": 5, "threshold": 0.4}, "$hits", on_empty=CONTINUE), Step("s2", "ASSERT", {"claim": query, "sources": "$hits", "confidence_threshold": 0.5}, "$claim", depends_on=["s1"])], query, synthesis={"inputs": ["$claim"]})


def validate(plan: Plan, schema: Schema, strict: bool = False) -> list[str]:
    """What is wrong with a plan, by step; an empty list if nothing is. Steps of unknown operators count as absent.
    strict: by the signatures also any missing argument and undeclared type, and bindings that no earlier step makes."""
    steps = list(enumerate(plan.steps))
    sound = [(n, s) for n, s in steps if s.op in SIGNATURES]
    named = {s.step_id: n for n, s in reversed(sound)}  # where an id comes first
    bound = {s.output_binding: n for n, s in reversed(sound)}
    wanted = [(n, s, arg, kind) for n, s in sound for arg, kind in SIGNATURES[s.op].items()]
    faults = [(n, 0, f"unknown_op:{s.op}@{s.step_id}") for n, s in steps if s.op not in SIGNATURES]
    faults += [(n, 1, f"duplicate_step_id:{s.step_id}") for n, s in sound if named[s.step_id] < n]
    faults += [(n, 2, f"binding_must_start_with_$:{s.step_id}") for n, s in sound if s.output_binding[:1] != "$"]
    faults += [(n, 3, f"forward_dependency:{s.step_id}->{d}") for n, s in sound for d in s.depends_on if named.get(d, n + 1) > n]
    for n, s, arg, kind in wanted:
        value, at = s.args.get(arg), (s.op, arg)
        if not value and (at in MISSING or strict and value is None):
            faults.append((n, 4, f"{MISSING.get(at, f'missing_argument_{arg}')}:{s.step_id}"))
        elif value and kind == "type" and value not in schema.types and (at in UNDECLARED or strict):
            faults.append((n, 4, f"{UNDECLARED.get(at, 'unknown_type')}:{value}@{s.step_id}"))
        elif strict and isinstance(value, str) and value[:1] == "$" and bound.get(value, n) >= n:
            faults.append((n, 5, f"unbound_argument:{value}@{s.step_id}"))
    claims = [s.output_binding for _, s in sound if s.op == "ASSERT"]
    end = [] if claims else ["missing_terminal_assert"]
    return [text for _, _, text in sorted(faults, key=lambda f: f[:2])] + end + [f"synthesis_input_not_bound:{b}" for b in plan.synthesis.get("inputs") or claims if b not in bound]


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after the ones they depend on: of those that may come next the first given. Dependencies that don't
    exist are ignored, of steps with one id the last counts."""
    by_id = {s.step_id: s for s in steps}
    place = {i: n for n, i in enumerate(by_id)}
    waits = {i: {d for d in s.depends_on if d in by_id} for i, s in by_id.items()}
    after: dict[str, list[str]] = {i: [] for i in by_id}
    for i, needs in waits.items():
        for d in needs:
            after[d].append(i)
    free, out = [place[i] for i, needs in waits.items() if not needs], []
    names = list(by_id)
    while free:
        i = names[heapq.heappop(free)]
        out.append(by_id[i])
        for next_ in after[i]:
            waits[next_].discard(i)
            if not waits[next_]:
                heapq.heappush(free, place[next_])
    if len(out) < len(by_id):
        raise ValueError(f"circular_dependency:{next(i for i in by_id if waits[i])}")
    return out

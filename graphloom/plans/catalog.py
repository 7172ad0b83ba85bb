"""Plans held in a table: read from text, checked and ordered by DataFrame functions, without a row leaving its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Schema
from .plan import MISSING, SIGNATURES, UNDECLARED

PLAN = "steps array<struct<step_id: string, op: string, args: map<string, string>, output_binding: string, depends_on: array<string>>>, synthesis struct<inputs: array<string>>, constraints struct<timeout_ms: bigint>"


def parsed(plans: DataFrame, text: str = "text") -> DataFrame:
    """plans with a column `plan`: the JSON object between a text's first `{` and its last `}`, null where there is none or
    it isn't a plan."""
    return plans.withColumn("plan", F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), PLAN, {"mode": "PERMISSIVE"}))


def known(s: Column) -> Column:
    return s["op"].isin(list(SIGNATURES))


def problems(plans: DataFrame, schema: Schema) -> DataFrame:
    """plans (with a column `plan`) and a column `problems`: what `plan.validate` says of each."""
    steps = F.coalesce("plan.steps", F.array())
    sound = F.filter(steps, known)
    bindings = F.transform(sound, lambda s: s["output_binding"])
    claims = F.transform(F.filter(sound, lambda s: s["op"] == "ASSERT"), lambda s: s["output_binding"])

    def said(when: Column, *text) -> Column:
        return F.when(when, F.concat(*(F.lit(t) if isinstance(t, str) else t for t in text)))

    def of(s: Column, n: Column) -> Column:
        before = F.transform(F.filter(F.slice(steps, 1, n), known), lambda x: x["step_id"])
        own, args = s["step_id"], s["args"]
        late = F.transform(F.filter(F.coalesce(s["depends_on"], F.array().cast("array<string>")), lambda d: (d != own) & ~F.array_contains(before, d)), lambda d: F.concat(F.lit("forward_dependency:"), own, F.lit("->"), d))
        found = [said(F.array_contains(before, own), "duplicate_step_id:", own), said(~F.coalesce(s["output_binding"].startswith("$"), F.lit(False)), "binding_must_start_with_$:", own)]
        asked = [said((s["op"] == op) & (F.coalesce(args[arg], F.lit("")) == ""), f"{text}:", own) for (op, arg), text in MISSING.items()]
        asked += [said((s["op"] == op) & (args[arg] != "") & ~args[arg].isin(list(schema.types)), f"{text}:", args[arg], "@", own) for (op, arg), text in UNDECLARED.items()]
        return F.when(known(s), F.concat(F.array(*found), late, F.array(*asked))).otherwise(F.array(F.concat(F.lit("unknown_op:"), s["op"], F.lit("@"), own)))

    inputs = F.when(F.size(F.coalesce("plan.synthesis.inputs", F.array().cast("array<string>"))) > 0, F.col("plan.synthesis.inputs")).otherwise(claims)
    unbound = F.transform(F.filter(inputs, lambda b: ~F.array_contains(bindings, b)), lambda b: F.concat(F.lit("synthesis_input_not_bound:"), b))
    end = F.array(said(F.size(claims) == 0, "missing_terminal_assert"))
    return plans.withColumn("problems", F.filter(F.concat(F.flatten(F.transform(steps, of)), end, unbound), lambda p: p.isNotNull()))


def in_order(plans: DataFrame) -> DataFrame:
    """plans (with a column `plan`) and columns `order`, the ids of the steps as `plan.ordered` puts them, and `circular`, the
    first step that can't be placed."""
    steps = F.coalesce("plan.steps", F.array())
    ids = F.transform(steps, lambda s: s["step_id"])
    none = F.array().cast("array<string>")

    def next_(placed: Column, _: Column) -> Column:
        free = F.filter(steps, lambda s: ~F.array_contains(placed, s["step_id"]) & F.forall(F.coalesce(s["depends_on"], none), lambda d: F.array_contains(placed, d) | ~F.array_contains(ids, d)))
        return F.concat(placed, F.transform(F.slice(free, 1, 1), lambda s: s["step_id"]))

    order = F.aggregate(steps, none, next_)
    out = plans.withColumn("order", order)
    return out.withColumn("circular", F.get(F.array_except(ids, F.col("order")), F.lit(0)))

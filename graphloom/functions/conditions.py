"""The filter language: one comparison, `<left> <operator> <right>`, as a Column."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import properties as P

# The language's left sides, operators and literals.
_FORM = re.compile(r"""\s*(?P<left>label|type_id|confidence|deprecated|properties\.(?P<prop>[A-Za-z_]\w*))\s*(?P<op>==|!=|<=|>=|<|>)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<num>-?\d+(?:\.\d+)?)|(?P<bool>true|false))\s*""", re.ASCII)
_COMPARE = {"==": operator.eq, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


def condition(text: str | None) -> Column:
    """A condition never null: malformed is false, values of another kind or missing compare
    false, and `!=` is the negation of `==`."""
    m = _FORM.fullmatch(text or "")
    if not m:
        return F.lit(False)
    words = m["dq"] if m["dq"] is not None else m["sq"]
    right = words if words is not None else float(m["num"]) if m["num"] else float(m["bool"] == "true")
    if m["prop"]:
        left = P.text(F.col("properties"), m["prop"]) if isinstance(right, str) else P.number(F.col("properties"), m["prop"])
    else:
        is_text = m["left"] in ("label", "type_id")
        if is_text != isinstance(right, str):
            return F.lit(m["op"] == "!=")
        left = F.col(m["left"]) if is_text else F.col(m["left"]).cast("double")
    if m["op"] == "!=":
        return ~F.coalesce(left == right, F.lit(False))
    return F.coalesce(_COMPARE[m["op"]](left, F.lit(right)), F.lit(False))

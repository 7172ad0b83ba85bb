"""Table functions for SQL: rows out of one value, with a schema that depends on the call.

    register(spark)
    spark.sql("select f.path, s.* from files f, lateral python_symbols(f.content, true) s")
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources.files import symbols_in

SHORT = StructType().add("kind", StringType()).add("name", StringType()).add("nth", IntegerType())
LONG = StructType().add("kind", StringType()).add("name", StringType()).add("nth", IntegerType()).add("line", IntegerType()).add("inside", StringType()).add("is_async", BooleanType())


class PythonSymbols:
    """python_symbols(content [, detail]): classes, functions and imported modules of a Python text (string or binary).

    kind, name, nth (the place in the tree, breadth first); with detail, a constant, also line, inside (names of the enclosing
    classes and functions, joined by dots; null at the top) and is_async. Null texts and syntax errors have no rows.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, detail: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(content.dataType, (StringType, BinaryType)):
            raise ValueError(f"python_symbols reads text or bytes, not {content.dataType.simpleString()}")
        if detail is not None and (not detail.isConstantExpression or not isinstance(detail.dataType, BooleanType)):
            raise ValueError("python_symbols: detail is a constant, true or false")
        return AnalyzeResult(schema=LONG if detail is not None and detail.value else SHORT)

    def eval(self, content, detail=False) -> Iterator[tuple]:
        for s in symbols_in(content):
            yield s if detail else s[:3]


def register(spark: SparkSession) -> None:
    # Not by Arrow, which makes a table of its own for each row of a lateral join.
    spark.udtf.register("python_symbols", udtf(PythonSymbols, useArrow=False))

"""A property graph as DataFrames, and ordered node lists over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import DEFAULT_SCHEMA, NODE_COLUMNS, Schema

NODE_NAMES = [c.split()[0] for c in NODE_COLUMNS.split(", ")]


@dataclass(frozen=True)
class TypeSource:
    """The typed rows that nodes of one type are made of, so that filters on properties and ids reach their scan.

    fields: a property's name to its column; make: rows to nodes; an id is `prefix` before the whole number `key`.
    """

    rows: DataFrame
    fields: dict[str, Column]
    make: Callable[[DataFrame], DataFrame]
    prefix: str | None = None
    key: str | None = None

    @property
    def nodes(self) -> DataFrame:
        return self.make(self.rows)


@dataclass
class Graph:
    """nodes and edges as in model; the other tables may be missing. sources: of the types that have typed rows. index:
    a VectorIndex that similarity searches go through, all embedded nodes if there is none; adjacency: the edges stored
    by endpoint, which navigation reads instead of edges if they are there."""

    nodes: DataFrame
    edges: DataFrame
    provenance: DataFrame | None = None
    uncertainty: DataFrame | None = None
    schema: Schema = field(default_factory=lambda: DEFAULT_SCHEMA)
    sources: dict[str, TypeSource] = field(default_factory=dict)
    index: object | None = None
    adjacency: object | None = None

    @property
    def live(self) -> DataFrame:
        return self.nodes.where(~F.col("deprecated"))

    @property
    def live_edges(self) -> DataFrame:
        return self.edges.where(~F.col("deprecated"))


@dataclass(frozen=True)
class Nodes:
    """A list of nodes: a DataFrame with the node columns, and the order of its rows.

    order holds SQL sort expressions; DataFrames have no order of their own, so an operator
    that needs one sorts by these, and prefixes are taken as top-n.
    """

    df: DataFrame
    order: tuple[str, ...] = ("id",)

    @property
    def sort(self) -> list[Column]:
        return [_sort_key(o) for o in self.order]

    @property
    def first(self) -> DataFrame:
        return self.df.orderBy(*self.sort).limit(1)

    def with_df(self, df: DataFrame) -> Nodes:
        return replace(self, df=df)


def _sort_key(key: str) -> Column:
    name, _, way = key.partition(" ")
    return F.col(name).desc_nulls_last() if way.lower() == "desc" else F.col(name).asc_nulls_last()

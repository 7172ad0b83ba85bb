"""A stored index of node embeddings: an inverted file of cells, added to by segments, rebuilt from live nodes.

The first nodes give the cells: k-means centres of their unit vectors (of a bounded sample), trained by Spark. Every add
appends one segment: its vectors sorted by cell, with their distance from the centre and a code of one byte for each
dimension; and then one row for each of its cells, the number of vectors and their largest distance (radius). Only
segments that have these rows are read, so a lost add leaves the index as it was, and no add rewrites another's files.

A query ranks cells by the distance of their centres.
- approximate: it reads the codes of the nearest cells, until these hold a share of all vectors, and the vectors themselves
  of the RERANK * k best codes alone.
- exact: it reads cells until they hold k vectors; the k-th distance t then bounds the rest: by the triangle inequality
  a cell whose centre is farther than t plus its radius holds none of the k nearest, and isn't read.
Cells and radii, which the driver reads, are as many as the cells: at most CELLS.

Ids are never removed or updated, as nodes that are deprecated later still count. Vectors of other lengths are left out;
a zero vector's score is 0; ties go to the smaller id.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import cosine, dot
from ..graph import Graph
from .state import newest

#: Cells at most, and vectors that they are trained on at most.
CELLS, SAMPLE = 4096, 200_000
#: The share of all vectors whose codes an approximate query reads, and how many times k vectors it reads whole.
SHARE, RERANK = 0.6, 8
VECTORS = "segment string, cell int, id string, embedding array<float>, code array<tinyint>, distance double"
BOUNDS = "segment string, cell int, n long, radius double"
CENTRES = "cell int, centre array<double>"


def unit(v: Column) -> Column:
    """The vector over its norm, in double precision; a zero vector stays."""
    return F.transform(F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))[0]


def gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


@dataclass(frozen=True)
class Search:
    """Hits (id, score), and of how many of the index' vectors codes and whole vectors were asked for."""

    hits: DataFrame
    codes: int
    vectors: int
    total: int


class VectorIndex:
    """Versions of the index below a folder: a rebuild makes a new one, an add a segment of the newest."""

    def __init__(self, spark: SparkSession, root: str, dimensions: int):
        self.spark, self.root, self.dimensions = spark, root.rstrip("/"), dimensions

    def version(self) -> int:
        """The newest version whose table of cells is whole, 0 if there is none."""
        return newest(self.spark, self.root, "centres/_SUCCESS")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/g{self.version()}/{name}")
        except Exception as e:  # the first add of a version
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def load(self) -> DataFrame:
        """The vectors of whole segments."""
        done = [r["segment"] for r in self._table("bounds", BOUNDS).select("segment").distinct().collect()]  # one for each add
        return self._table("vectors", VECTORS).where(F.col("segment").isin(done))

    def _fitting(self, nodes: DataFrame) -> DataFrame:
        fits = nodes.where(F.size("embedding") == self.dimensions).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        return fits.dropDuplicates(["id"]).withColumn("u", unit(F.col("embedding")))

    def _train(self, rows: DataFrame) -> None:
        """Cells of a new version: about four times the root of the vectors' number."""
        n = rows.count()
        sample = rows if n <= SAMPLE else rows.orderBy(F.xxhash64("id")).limit(SAMPLE)
        k = max(1, min(CELLS, int(4 * n**0.5), n // 2))
        if n > 1:
            model = KMeans(k=k, maxIter=8, seed=5, initMode="random", featuresCol="f").fit(sample.select(array_to_vector("u").alias("f")))
            centres = [c.tolist() for c in model.clusterCenters()]
        else:
            centres = [r["u"] for r in sample.select("u").collect()] or [[0.0] * self.dimensions]
        self.spark.createDataFrame(list(enumerate(centres)), CENTRES).coalesce(1).write.parquet(f"{self.root}/g{self.version() + 1}/centres")

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.schema(CENTRES).parquet(f"{self.root}/g{self.version()}/centres").orderBy("cell").collect()  # CELLS at most
        return np.array([r["centre"] for r in rows])

    def _append(self, rows: DataFrame) -> None:
        """One segment of rows (id, embedding, u)."""
        centres, folder, segment = self._centres(), f"{self.root}/g{self.version()}", uuid.uuid4().hex
        square = (centres**2).sum(1)

        def place(it):
            import pyarrow as pa

            for b in it:
                u = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                cell = (square - 2 * (u @ centres.T)).argmin(1)
                far = np.sqrt(((u - centres[cell]) ** 2).sum(1))
                code = np.rint(np.clip(u, -1, 1) * 127).astype(np.int8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, u.shape[1], dtype=np.int32)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([segment] * b.num_rows), pa.array(cell.astype(np.int32)), b.column(0), b.column(1), lists, pa.array(far)], names=["segment", "cell", "id", "embedding", "code", "distance"])

        rows.mapInArrow(place, VECTORS).repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode("append").partitionBy("segment").parquet(f"{folder}/vectors")
        made = self.spark.read.schema(VECTORS).parquet(f"{folder}/vectors").where(F.col("segment") == segment)
        made.groupBy("segment", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).coalesce(1).write.mode("append").parquet(f"{folder}/bounds")

    def add(self, nodes: DataFrame) -> None:
        """A segment with the nodes whose id isn't there yet."""
        rows = self._fitting(nodes)
        if not self.version():
            self._train(rows)
        new = rows.join(self.load().select("id"), "id", "left_anti")
        if not new.isEmpty():
            self._append(new)

    def rebuild(self, g: Graph) -> None:
        """A version of the live nodes alone, as where no version can be read."""
        rows = self._fitting(g.live)
        self._train(rows)
        if not rows.isEmpty():
            self._append(rows)

    def search(self, vector: list[float], k: int, exact: bool = False, share: float = SHARE) -> Search:
        """The k nearest vectors: all of them where exact, else those that the nearest cells' codes tell."""
        if not self.version():
            return Search(self.spark.createDataFrame([], "id string, score double"), 0, 0, 0)
        asked = np.asarray(vector, float)
        q = asked / (np.linalg.norm(asked) or 1)
        centres, rows = self._centres(), self.load()
        bounds = {r["cell"]: (r["n"], r["radius"]) for r in self._table("bounds", BOUNDS).groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}
        far = np.sqrt(((centres - q) ** 2).sum(1))
        near = sorted(bounds, key=lambda c: (far[c], c))
        total = sum(n for n, _ in bounds.values())

        def first(least: float) -> list[int]:
            held = np.cumsum([bounds[c][0] for c in near])
            return near[: int(np.searchsorted(held, least)) + 1]

        score = cosine(F.col("embedding"), F.array(*map(F.lit, asked.tolist())))
        best = (F.desc("score"), F.asc("id"))
        if exact:
            cells = first(k)
            seen = rows.where(F.col("cell").isin(cells)).select("id", score.alias("score")).orderBy(*best).limit(k).collect()
            if not q.any() or len(seen) < k:
                cells = near
            else:
                reach = (2 - 2 * min(seen[-1]["score"], 1)) ** 0.5 + 1e-6
                cells = [c for c in near if far[c] - bounds[c][1] <= reach]
            codes, read = 0, sum(bounds[c][0] for c in cells)
            chosen = rows.where(F.col("cell").isin(cells))
        else:
            cells = first(max(share * total, k))
            codes = sum(bounds[c][0] for c in cells)
            coarse = F.array(*(F.lit(float(x)) for x in q))
            of_codes = rows.where(F.col("cell").isin(cells)).select("cell", "id", dot(F.col("code"), coarse).alias("score"))
            found = of_codes.orderBy(*best).limit(RERANK * k).collect()  # RERANK * k ids
            read = len(found)
            chosen = rows.where(F.col("cell").isin(sorted({r["cell"] for r in found})) & F.col("id").isin([r["id"] for r in found]))
        return Search(chosen.select("id", score.alias("score")).orderBy(*best).limit(k), codes, read, total)

    def query(self, vector: list[float], k: int, exact: bool = False) -> DataFrame:
        """(id, score) of the k nearest."""
        return self.search(vector, k, exact).hits

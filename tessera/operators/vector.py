"""Vector search: exact top-k by cosine similarity, Euclidean distance or inner product, and an index of lists.

Scores are SQL expressions over arrays, so the scan, the filter and the top-k (one heap per task) all stay in the JVM.
"""

from __future__ import annotations

from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import first_per_key


class Metric(Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    INNER_PRODUCT = "inner_product"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(vector: Column, query: list[float], metric: Metric) -> Column:
    """Similarity (cosine, inner product) or distance (Euclidean) of an array column to a fixed vector.

    Null for arrays of another length or with null elements; the cosine with a zero vector is null."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric is Metric.INNER_PRODUCT:
        s = _dot(vector, q)
    elif metric is Metric.EUCLIDEAN:
        s = F.sqrt(F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x))
    else:
        norm = sum(float(x) ** 2 for x in query) ** 0.5
        s = F.try_divide(_dot(vector, q), F.sqrt(_dot(vector, vector)) * F.lit(norm))
    return F.when(F.size(vector) == len(query), s)


class VectorSearch:
    """``VectorSearch(df, "embedding", "id").metric(Metric.COSINE).top_k(query, 10, filter)``"""

    def __init__(self, df: DataFrame, vector: str, id: str, metric: Metric = Metric.COSINE, dimensions: int | None = None):
        self.df, self.vector, self.id, self._metric, self.dimensions = df, vector, id, metric, dimensions

    def metric(self, metric: Metric) -> VectorSearch:
        return VectorSearch(self.df, self.vector, self.id, metric, self.dimensions)

    def top_k(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The ``k`` nearest rows: id and ``score``, best first; equal scores by id. Rows that match ``where`` only."""
        if k < 1:
            raise ValueError("k is one at least")
        if not query:
            raise ValueError("the query has no dimensions")
        if self.dimensions is not None and len(query) != self.dimensions:
            raise ValueError(f"the query has {len(query)} dimensions, the column {self.dimensions}")
        df = self.df if where is None else self.df.filter(where)
        scored = df.select(self.id, score(F.col(self.vector), query, self._metric).alias("score")).filter(F.col("score").isNotNull())
        best = F.col("score").asc() if self._metric is Metric.EUCLIDEAN else F.col("score").desc()
        return scored.orderBy(best, self.id).limit(k)

    @staticmethod
    def unavailable_reason() -> str | None:
        """Why there is no graph index: scans are exact and spread over the cluster; ``VectorIndex`` trades recall."""
        return "no graph index here: searches scan all vectors, which is exact; VectorIndex scans the nearest lists only"


def _best_of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, own, s = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((own, s if metric is Metric.EUCLIDEAN else -s, i))
    i, own, s = i[order], own[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], own[place < k], s[place < k]


class VectorIndex:
    """Lists of vectors around centres: a search looks into the nearest few lists and ranks their vectors exactly.

    Centres are fitted on ``SAMPLE`` vectors at most, those with the smallest hashes of their ids; every vector that has
    the right length is put into the list of its nearest centre. Written as Parquet by list, so that a search reads the
    lists it looks into. The more lists a search probes, the higher its recall; with all of them it is exact. ``probes``
    is set so that ``RECALL`` of the true neighbours of ``QUERIES`` sample vectors, found by brute force in the sample, lie
    in the lists probed.
    """

    SAMPLE, QUERIES, RECALL, NEIGHBOURS = 20_000, 200, 0.97, 10
    #: Queries that are answered in one pass over the vectors.
    BLOCK = 512

    def __init__(self, spark: SparkSession, location: str, centres: np.ndarray, id: str, vector: str, metric: Metric, probes: int):
        self.spark, self.location, self.centres, self.id, self.vector, self.metric, self.probes = spark, location, centres, id, vector, metric, probes

    @classmethod
    def build(cls, df: DataFrame, vector: str, id: str, location: str, lists: int = 64, metric: Metric = Metric.COSINE, rounds: int = 15) -> VectorIndex:
        usable = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
        picked = usable.orderBy(F.xxhash64(id), id).limit(cls.SAMPLE).select(vector).toArrow()[vector].to_pylist()
        if not picked:
            raise ValueError("no vectors")
        size = len(picked[0])
        sample = np.array([v for v in picked if len(v) == size and None not in v], float)
        if metric is Metric.COSINE:
            sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(0)
        centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
        for _ in range(rounds):
            near = cls._nearest(sample, centres)
            centres = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        probes = cls._probes(sample, centres, metric)
        shared = df.sparkSession.sparkContext.broadcast(centres)
        unit = metric is Metric.COSINE

        @F.pandas_udf("int")
        def list_of(vectors: pd.Series) -> pd.Series:
            v = np.stack(vectors.to_numpy()).astype(float)
            if unit:
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            return pd.Series(cls._nearest(v, shared.value))

        placed = usable.filter((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull())).withColumn("_list", list_of(vector))
        # a list's vectors go to as many tasks as there are cores for each list, so that large lists are no single task
        spread = max(1, -(-df.sparkSession.sparkContext.defaultParallelism // len(centres)))
        placed.repartition(len(centres) * spread, "_list", F.pmod(F.xxhash64(id), F.lit(spread))).write.mode("overwrite").partitionBy("_list").parquet(location)
        return cls(df.sparkSession, location, centres, id, vector, metric, probes)

    @staticmethod
    def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1)[None, :] - 2 * v @ centres.T).argmin(axis=1)

    @staticmethod
    def _order(q: np.ndarray, centres: np.ndarray, metric: Metric) -> np.ndarray:
        """The lists, nearest first."""
        far = -(centres @ q) if metric is Metric.INNER_PRODUCT else ((centres - q) ** 2).sum(axis=1)
        return np.argsort(far, kind="stable")

    @classmethod
    def _probes(cls, sample: np.ndarray, centres: np.ndarray, metric: Metric) -> int:
        """How many lists hold ``RECALL`` of the sample's true neighbours."""
        list_of, ranks = cls._nearest(sample, centres), []
        for q in sample[: cls.QUERIES]:
            far = -(sample @ q) if metric is Metric.INNER_PRODUCT else ((sample - q) ** 2).sum(axis=1)
            place = np.empty(len(centres), int)
            place[cls._order(q, centres, metric)] = np.arange(len(centres))
            ranks.append(place[list_of[np.argsort(far, kind="stable")[: cls.NEIGHBOURS + 1]]])
        return int(np.quantile(np.concatenate(ranks), cls.RECALL, method="higher")) + 1

    def neighbours(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """``query`` (an id), the ``k`` nearest ids and their ``score`` for every row of ``queries`` (a stated set with the
        index's columns), over all vectors of the lists each query probes; with ``exact`` over all lists.

        Queries go to the vectors in blocks of ``BLOCK``, as arrays in every task; each task keeps the best ``k`` per query
        of what it has read, and only these meet."""
        size, block, unit, best = self.centres.shape[1], 0, self.metric is Metric.COSINE, None
        rows = queries.filter((F.size(self.vector) == size) & ~F.exists(self.vector, lambda x: x.isNull())).select(F.col(self.id).alias("query"), self.vector).orderBy("query").toArrow()
        kind = queries.schema[self.id].dataType.simpleString()
        vectors = self.spark.read.parquet(self.location).select("_list", self.id, self.vector)
        for block in range(0, rows.num_rows, self.BLOCK):
            part = rows.slice(block, self.BLOCK)
            ids, q = np.array(part["query"].to_pylist()), np.array(part[self.vector].to_pylist(), float)
            lengths = np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            probed = np.zeros((len(q), len(self.centres)), bool)
            for i, v in enumerate(q / lengths if unit else q):
                probed[i, self._order(v, self.centres, self.metric)[: probes or self.probes]] = True
            shared = self.spark.sparkContext.broadcast((ids, q, lengths, probed | exact))
            found = vectors.filter(F.col("_list").isin(*np.flatnonzero(shared.value[3].any(axis=0)).tolist())).mapInArrow(self._best(shared, k), f"query {kind}, {self.id} {kind}, score double")
            best = found if best is None else best.unionAll(found)
        if best is None:
            return self.spark.createDataFrame([], f"query {kind}, {self.id} {kind}, score double")
        order = F.col("score").asc() if self.metric is Metric.EUCLIDEAN else F.col("score").desc()
        return first_per_key(best, ["query"], [order, F.col(self.id)], k)

    def _best(self, shared, k: int):
        metric, name = self.metric, self.id

        def run(batches):
            ids, q, lengths, probed = shared.value
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            kind = None
            for batch in batches:
                kind = batch.schema.field(1).type
                list_of, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                v = np.stack(batch.column(2).to_numpy(zero_copy_only=False)).astype(float)
                s = q @ v.T
                if metric is Metric.COSINE:
                    s = s / (lengths * np.maximum(np.linalg.norm(v, axis=1), 1e-300)[None, :])
                elif metric is Metric.EUCLIDEAN:
                    s = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] - 2 * s + (v**2).sum(axis=1)[None, :], 0))
                worth = np.where(probed[:, list_of], -s if metric is Metric.EUCLIDEAN else s, -np.inf)
                for i in range(len(q)):
                    at = np.flatnonzero(worth[i] > -np.inf)
                    at = at[np.lexsort((own[at], -worth[i][at]))[:k]]
                    held.append((np.full(len(at), i), own[at], s[i][at]))
                if len(held) > 8 * len(q):
                    held = [_best_of(held, k, metric)]
            if held and kind is not None:
                i, own, s = _best_of(held, k, metric)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], kind), pa.array(own, kind), pa.array(s, pa.float64())], names=["query", name, "score"])

        return run

    def top_k(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        q = np.array(query, float)
        if self.metric is Metric.COSINE:
            q = q / max(np.linalg.norm(q), 1e-12)
        near = [int(i) for i in self._order(q, self.centres, self.metric)[: probes or self.probes]]
        lists = self.spark.read.parquet(self.location).filter(F.col("_list").isin(near))
        return VectorSearch(lists, self.vector, self.id, self.metric).top_k(query, k, where)

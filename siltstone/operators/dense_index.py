"""A stored index for exact cosine search that passes over what can't count.

Unit vectors lie on a sphere, where angles are distances.  Each vector belongs to its nearest centre, and a centre's vectors are cut by
their angle to it into cells of bounded size.  A query at angle t from a centre is at least max(0, t - high, low - t) from every vector of a
cell with angles from low to high.  The cells nearest to a query give its k-th score so far; of all others only those are read that the bound
doesn't rule out.  Centres are fitted on a bounded sample; a poor sample costs reading, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from siltstone.operators.retrieval import top
from siltstone.sources.folders import written

#: Centres at most (the square root of the rows where that is less), and vectors that they are fitted on at most, by lowest hash of the id.
CENTRES, SAMPLE = 1024, 65_536
#: Bytes of the vectors in one cell, and queries that meet a cell in one task.
CELL_BYTES, QUERY_PART = 1 << 20, 1024
#: Centres whose cells are looked at first, and cells that are read first, for each query.
FIRST_CENTRES, FIRST_CELLS = 4, 4
#: Scores have four places, so a row may count that is this much worse than the k-th score.
SLACK = 1e-4


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(float)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1, 1))


def build(vectors: DataFrame, path: str, centres: int = CENTRES, cell_bytes: int = CELL_BYTES) -> None:
    """Writes the index of vectors (id, vector) to path: centres, cells (cell, cluster, low, high, n, ids, units).

    Rows without id or vector are left out; vectors of zeros make a cluster of their own, numbered after the last centre.
    """
    rows = vectors.filter("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    solid = rows.filter(F.exists("vector", lambda x: x != 0))
    sample = written(solid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("vector").alias("features")), "dense-sample")
    k = min(centres, int(np.ceil(np.sqrt(solid.count()))))
    found: list[list[float]] = []
    if k > 1:
        model = KMeans(k=k, maxIter=5, seed=1, distanceMeasure="cosine").fit(sample)
        found = [c.tolist() for c in model.clusterCenters()]
    elif k == 1:
        found = [sample.first()["features"].toArray().tolist()]
    vectors.sparkSession.createDataFrame(list(enumerate(found)), "cluster int, centre array<double>").write.parquet(f"{path}/centres")
    units = _unit(pd.Series(found)) if found else np.empty((0, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = _unit(batch["vector"])
                solid = own.any(axis=1)
                cluster, angle = np.full(len(own), len(units)), np.zeros(len(own))
                if solid.any():
                    angles = _angles(own[solid], units)
                    cluster[solid], angle[solid] = angles.argmin(1), angles.min(1)
                yield pd.DataFrame({"id": batch["id"], "cluster": cluster.astype(np.int32), "angle": angle, "unit": [u.tobytes() for u in own]})

    id_field = rows.schema["id"]
    fields = [id_field, StructField("cluster", IntegerType()), StructField("angle", DoubleType()), StructField("unit", BinaryType())]
    placed = written(rows.mapInPandas(assign, StructType(fields)), "dense-assigned").repartitionByRange("cluster", "angle", "id").sortWithinPartitions("cluster", "angle", "id")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, None

        def cut(rows: pd.DataFrame, last: bool) -> tuple[list[dict], pd.DataFrame]:
            """The finished cells at the begin of the rows, and the rows after them."""
            nonlocal number
            size = max(1, cell_bytes // max(1, len(rows["unit"].iloc[0])))
            cluster = rows["cluster"].to_numpy()
            begins = np.flatnonzero(np.diff(cluster, prepend=-1))
            nth = np.arange(len(rows)) - np.repeat(begins, np.diff(begins, append=len(rows)))
            edges = [*np.flatnonzero(nth % size == 0), *([len(rows)] if last else [])]
            out = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = rows.iloc[lo:hi]
                out.append({"cell": part << 32 | number, "cluster": cluster[lo], "low": own["angle"].iloc[0], "high": own["angle"].iloc[-1], "n": hi - lo, "ids": own["id"].to_numpy(), "units": b"".join(own["unit"])})
                number += 1
            return out, rows.iloc[edges[-1] :]

        for batch in batches:
            if len(batch):
                done, held = cut(batch if held is None else pd.concat([held, batch]), False)
                if done:
                    yield pd.DataFrame(done)
        if held is not None:
            yield pd.DataFrame(cut(held, True)[0])

    fields = [StructField("cell", LongType()), StructField("cluster", IntegerType()), StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("n", LongType()), StructField("ids", ArrayType(id_field.dataType)), StructField("units", BinaryType())]
    placed.mapInPandas(cells, StructType(fields)).write.parquet(f"{path}/cells")


def _near(queries: DataFrame, centres: np.ndarray, spans: dict, first: int | None) -> DataFrame:
    """query_id, cluster, angle, reach: clusters that a query (query_id, vector, least) has to look at, the nearest `first` of them if given.

    spans: the lowest and highest angle of each cluster.  Cells further than reach from the query's angle can't count.
    """
    low, high = (np.array([spans.get(c, (4.0, 4.0))[i] for c in range(len(centres) + 1)]) for i in (0, 1))
    held = np.array([c in spans for c in range(len(centres) + 1)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = _unit(batch["vector"])
            least = batch["least"].fillna(-2.0).to_numpy(float)
            solid = own.any(axis=1)
            # a query of zeros has the score 0 with every row, and a row of zeros with every query
            reach = np.where(solid, np.arccos(np.clip(least - SLACK, -1, 1)) + 1e-7, 4.0)
            angles = np.zeros((len(own), len(low)))
            if len(centres):
                angles[:, :-1] = _angles(own, centres)
            gaps = np.maximum(0, np.maximum(angles - high, low - angles))
            wanted = held & (gaps <= reach[:, None])
            wanted[:, -1] = held[-1] & (least <= SLACK)
            if first is not None:
                order = np.lexsort((angles, gaps, ~wanted), axis=1)[:, :first]
                chosen = np.zeros_like(wanted)
                np.put_along_axis(chosen, order, True, 1)
                wanted &= chosen
            q, c = np.nonzero(wanted)
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[q], "cluster": c.astype(np.int32), "angle": angles[q, c], "reach": reach[q]})

    return queries.mapInPandas(run, StructType([queries.schema["query_id"], StructField("cluster", IntegerType()), StructField("angle", DoubleType()), StructField("reach", DoubleType())]))


def _scores(pairs: DataFrame, queries: DataFrame, cells: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, id, score: the best k rows of each (query_id, cell); some QUERY_PART queries meet a cell in a task, however many ask for it."""
    asked = pairs.select("query_id", "cell").join(queries.select("query_id", "vector"), "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    wanted = pairs.select(F.col("cell").alias("at"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("share")).distinct()
    read = wanted.join(cells.select(F.col("cell").alias("at"), "ids", "units"), "at")

    def run(asking: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(cell):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        own = np.asarray(cell["ids"].iloc[0])
        rows = np.frombuffer(cell["units"].iloc[0]).reshape(len(own), -1)
        s = np.round(_unit(asking["vector"]) @ rows.T, 4)
        order = np.lexsort((np.broadcast_to(np.unique(own, return_inverse=True)[1], s.shape), -s), axis=1)[:, :k]
        return pd.DataFrame({"query_id": np.repeat(asking["query_id"].to_numpy(), order.shape[1]), "id": own[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    schema = StructType([pairs.schema["query_id"], StructField("id", cells.schema["ids"].dataType.elementType), StructField("score", DoubleType())])
    return asked.groupBy("cell", "part").cogroup(read.groupBy("at", "share")).applyInPandas(run, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, first_cells: int = FIRST_CELLS) -> DataFrame:
    """query_id, id, score (four places), rank: the rows that dense gives for queries (query_id, vector), from the index at path.

    query_id is unique.  Queries stay distributed; the driver sees the centres and one pair of angles for each.
    """
    return _search(spark, path, queries, k, first_cells)[0]


def _search(spark: SparkSession, path: str, queries: DataFrame, k: int, first_cells: int = FIRST_CELLS) -> tuple[DataFrame, DataFrame]:
    """The rows of search, and the pairs (query_id, cell) that were read for them."""
    cells = spark.read.parquet(f"{path}/cells")
    meta = cells.select("cell", "cluster", "low", "high")
    spans = {r["cluster"]: (r["low"], r["high"]) for r in meta.groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    found = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()]
    centres = _unit(pd.Series(found)) if found else np.empty((0, 1))
    asked = written(queries.filter("query_id is not null and vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")), "dense-asked")
    parts = max(1, -(-asked.count() // QUERY_PART))
    order = (F.col("score").desc(), F.col("id"))
    gap = F.greatest(F.lit(0.0), F.col("angle") - F.col("high"), F.col("low") - F.col("angle"))

    near = _near(asked.withColumn("least", F.lit(None).cast("double")), centres, spans, FIRST_CENTRES).join(meta, "cluster").withColumn("gap", gap)
    pairs = written(top(near, first_cells, F.col("gap"), F.col("cell"), rank="nth").select("query_id", "cell"), "dense-first")
    first = written(top(_scores(pairs, asked, cells, k, parts), k, *order), "dense-first-rows")
    least = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = _near(asked.join(least, "query_id", "left"), centres, spans, None).join(meta, "cluster").filter(gap <= F.col("reach"))
    rest = written(open_.select("query_id", "cell").join(pairs, ["query_id", "cell"], "left_anti"), "dense-rest")
    rows = first.drop("rank").unionByName(_scores(rest, asked, cells, k, parts))
    return top(rows, k, *order), pairs.unionByName(rest)

"""Neighbour graph and layout of vectors: positions, centroids, pulls, degrees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quarry.functions.text import half_up
from quarry.functions.vector import dot

DOCUMENT_PULL, SOURCE_PULL = 0.42, 0.16
#: Nodes of one graph at most.
NODES_MOST = 1200


def positions(rows: DataFrame, radius: float = 6.0) -> DataFrame:
    """(id, x, y, z): the first three principal components of (id, vec), centred, scaled to the radius.

    The sign of an axis is set so that its largest loading is positive. Fewer than four rows give no axes and no rows.
    """
    vectors = rows.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    if rows.limit(4).count() < 4:
        return rows.sparkSession.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, x double, y double, z double")
    model = PCA(k=3, inputCol="v", outputCol="p").fit(vectors)
    loads = np.array(model.pc.toArray())
    signs = [float(np.sign(loads[np.abs(loads[:, i]).argmax(), i])) for i in range(3)]
    p = vector_to_array("p")
    raw = model.transform(vectors).select("id", *[(p[i] * signs[i]).alias(c) for i, c in enumerate("xyz")])
    mean = raw.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    centred = raw.join(F.broadcast(mean)).select("id", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    top = centred.agg(F.greatest(F.lit(1e-6), *[F.max(F.abs(F.col(c))) for c in "xyz"]).alias("top"))
    return centred.join(F.broadcast(top)).select("id", *[half_up(F.col(c) * radius / F.col("top"), 4).alias(c) for c in "xyz"])


class Space:
    """Axes fitted on (id, vec): three principal components with their mean, scale to a radius, and an offset."""

    def __init__(self, rows: DataFrame, radius: float = 6.0, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.offset, self.axes = offset, None
        if rows.limit(4).count() < 4:
            return
        vectors = rows.select(array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
        loads = np.array(PCA(k=3, inputCol="v", outputCol="p").fit(vectors).pc.toArray()).T
        self.axes = loads * np.sign(loads[np.arange(3), np.abs(loads).argmax(1)])[:, None]
        raw = [self._raw(i) for i in range(3)]
        mean = rows.agg(*[F.avg(c) for c in raw]).first()  # a row
        self.mean = [float(m) for m in mean]
        top = rows.agg(F.greatest(*[F.max(F.abs(c - m)) for c, m in zip(raw, self.mean)])).first()[0]
        self.scale = radius / max(1e-6, top)

    def _raw(self, i: int) -> Column:
        return dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in self.axes[i]]))

    def place(self, rows: DataFrame) -> DataFrame:
        """(id, x, y, z) of rows (id, vec), fitted or new; without axes all lie at the offset."""
        at = lambda i: F.lit(float(self.offset[i])) if self.axes is None else (self._raw(i) - self.mean[i]) * self.scale + self.offset[i]
        return rows.select("id", *[half_up(at(i), 4).alias(c) for i, c in enumerate("xyz")])


def attached(hits: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """(hit, id, weight): links from each hit (id, vec) to the k sampled nodes (id, vec) of the greatest dot product.

    The sample of a graph is bounded by its definition (1,200 nodes), so each hit meets it as one small table.
    """
    n = nodes.select(F.col("id").alias("node"), F.col("vec").alias("v"))
    pairs = hits.join(F.broadcast(n.limit(NODES_MOST)), hits["id"] != F.col("node")).select(F.col("id").alias("hit"), F.col("node").alias("id"), half_up(dot(F.col("vec"), F.col("v")), 4).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("hit").orderBy(F.desc("weight"), "id"))
    return pairs.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def single_graph(rows: DataFrame, n: int = 400, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, document, source, x, y, z), links (a, b, weight)) of a sample of (id, document, source, vec).

    n is put between 50 and 1,200, k between 1 and 6. Positions are those of the sample's axes, pulled toward its documents and sources.
    """
    n, k = min(max(n, 50), NODES_MOST), min(max(k, 1), 6)
    some = rows.where("id is not null and vec is not null").orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(n)
    placed = Space(some).place(some).join(some.select("id", "document", "source"), "id")
    near = attached(some.select("id", "vec"), some, k)
    edges = links(near.select(F.col("hit").alias("query_id"), "id", F.col("weight").alias("cosine")))
    return bundled(placed).join(some.select("id", "document", "source"), "id"), edges


def bundled(placed: DataFrame) -> DataFrame:
    """Positions (id, document, source, x, y, z) pulled toward the centroids of their document and source."""
    rest = 1 - DOCUMENT_PULL - SOURCE_PULL
    centre = lambda by, p: placed.groupBy(by).agg(*[F.avg(c).alias(p + c) for c in "xyz"])
    both = placed.join(centre("document", "d"), "document").join(centre("source", "s"), "source")
    pull = lambda c: F.col(c) * rest + F.col(f"d{c}") * DOCUMENT_PULL + F.col(f"s{c}") * SOURCE_PULL
    return both.select("id", *[F.round(pull(c), 6).alias(c) for c in "xyz"])


def links(near: DataFrame) -> DataFrame:
    """(a, b, weight): undirected links of (query_id, id, cosine), each once."""
    pair = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), half_up(F.col("cosine"), 4).alias("weight"))
    return pair.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def spiral(groups: DataFrame, key: str, step: float = 1.6) -> DataFrame:
    """(key, x, y, z): centres of the groups on a flattened golden-angle spiral, in order of the key; one group is at the origin."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    rows = groups.select(key).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key)) - 1).withColumn("n", n)
    radius = F.greatest(F.lit(7.0), 3 * F.sqrt("n") * step)
    y = F.when(F.col("n") > 1, 1 - 2 * F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    ring = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    turn = F.lit(math.pi * (3 - math.sqrt(5))) * F.col("i")
    at = lambda v: F.when(F.col("n") > 1, F.round(v * radius, 4)).otherwise(0.0)
    return rows.select(key, at(F.cos(turn) * ring).alias("x"), at(y * 0.55).alias("y"), at(F.sin(turn) * ring).alias("z"))


def sampled(rows: DataFrame, group: str, key: str, n: int, seed: str = "") -> DataFrame:
    """At most n rows of each group, in the order of a seeded hash of the key: the same rows each time."""
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    return rows.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def group_graphs(rows: DataFrame, n: int = 400, least: int = 24, k: int = 3, radius: float = 3.0) -> DataFrame:
    """(group, id, x, y, z, links): a graph per group of a sample of (id, group, vec), each at its place on the spiral.

    The sample is the feature: n nodes over all groups, at least `least` in each, so a task never holds more. Positions are
    the sample's first three principal components, signs set by the largest loading; fewer than four nodes form a ring.
    links are the k nearest of the group's sample by dot product, (id, weight). Null vectors and ids are left out; a null
    group counts as the empty string.
    """
    rows = rows.where("id is not null and vec is not null").select("id", F.coalesce(F.col("group").cast("string"), F.lit("")).alias("group"), "vec")
    count = rows.select("group").distinct().count()
    some = sampled(rows, "group", "id", max(least, n // max(1, count)))

    def place(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        x = np.array([np.nan_to_num(np.asarray(v, dtype=float)) for v in f["vec"]])
        if len(x) < 4 or x.shape[1] < 3:
            turn = 2 * math.pi * np.arange(len(x)) / len(x)
            p = np.stack([np.cos(turn), np.sin(turn), 0 * turn], axis=1)
        else:
            centred = x - x.mean(0)
            loads = np.linalg.svd(centred, full_matrices=False)[2][:3]
            loads *= np.sign(loads[np.arange(3), np.abs(loads).argmax(1)])[:, None]
            p = centred @ loads.T
        p *= radius / max(1e-6, np.abs(p).max())
        dot = x @ x.T
        np.fill_diagonal(dot, -np.inf)
        near = np.argsort(-dot, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        f["links"] = [[{"id": f["id"][int(j)], "weight": math.floor(dot[i, j] * 1e4 + 0.5) / 1e4} for j in near[i]] for i in range(len(x))]
        f["x"], f["y"], f["z"] = p.T
        return f[["group", "id", "x", "y", "z", "links"]]

    link = S.StructType([S.StructField("id", rows.schema["id"].dataType), S.StructField("weight", S.DoubleType())])
    fields = [S.StructField("group", S.StringType()), S.StructField("id", rows.schema["id"].dataType), *[S.StructField(c, S.DoubleType()) for c in "xyz"], S.StructField("links", S.ArrayType(link))]
    placed = some.groupBy("group").applyInPandas(place, S.StructType(fields))
    centre = spiral(rows, "group").select("group", *[F.col(c).alias(f"c{c}") for c in "xyz"])
    return placed.join(centre, "group").select("group", "id", *[half_up(F.col(c) + F.col(f"c{c}"), 4).alias(c) for c in "xyz"], "links")

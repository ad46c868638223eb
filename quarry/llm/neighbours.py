"""p5: the most similar vectors of every vector, by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.skew import skew_join

#: Rows the codebooks are fitted on, at most; every row is indexed.
SAMPLE = 8192
#: Centroids per half; the index has CENTROIDS x CENTROIDS cells.
CENTROIDS = 64
#: Cells are stored in blocks: a sixteenth of all vectors each, within these bounds.
BLOCK_SHARE, BLOCK_LEAST, BLOCK_MOST = 16, 2048, 65_536
#: Nearest cells are probed until they hold so many sixteenths of all entries; fewer will do where only close neighbours are wanted.
REACH, CLOSE_REACH = 2.0, 0.5
#: Queries that one task answers from a slice, about so many at most; further ones go to copies of the slice.
QUERIES_MOST = 65_536
#: Queries multiplied with a block at once.
CHUNK = 512
#: Products looked at and pairs reranked at once, at most; one query's products are not divided.
PRODUCTS, PAIRS = 2_097_152, 16_384
#: What float32 may take off a cosine: candidates this far below a bar are reranked too.
SLACK = 1e-5


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return x[:, :h], x[:, h:]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a binary column as a matrix, without a copy per row."""
    col = batch.column("vec")
    if not len(col):
        return np.zeros((0, dim), np.float32)
    first = int(np.frombuffer(col.buffers()[1], dtype=np.int32, count=col.offset + 1)[col.offset])
    return np.frombuffer(col.buffers()[2], dtype=np.float32, offset=first, count=len(col) * dim).reshape(len(col), dim)


def unit_vectors(rows: DataFrame, dim: int, vector: str = "embedding", key: str = "embedding_id") -> DataFrame:
    """(id, vec): the usable vectors as unit length float32 bytes. Usable: `dim` finite numbers, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            good = np.flatnonzero(sizes == dim)
            if not len(good):
                continue
            taken = lists.take(pa.array(good))
            x = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            fine = np.isfinite(norm) & (norm > 0)
            x = (x[fine] / norm[fine, None]).astype(np.float32)
            ids = b.column(0).take(pa.array(good[fine]))
            offsets = pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * dim * 4).tobytes())
            vec = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())])
            yield pa.RecordBatch.from_arrays([ids, vec], ["id", "vec"])

    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), vector).mapInArrow(run, "id string, vec binary")


def best(q: np.ndarray, base: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of base, cosine): the k best rows of base for each row of q, of those with a cosine of at least `least`.

    Candidates are those at the k-th best float32 product or above, so about k a query, and all its ties (where few reach
    `least`, all of those); they are reranked in float64. Products and reranked pairs are taken in slices, so ties and near copies take no more memory than others.
    """
    out = []
    step = max(1, PRODUCTS // len(base))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        g = part @ base.T
        above = g >= least - SLACK
        if len(base) > k and np.count_nonzero(above) > PAIRS:
            above &= g >= (np.partition(g, -k, axis=1)[:, -k] - SLACK)[:, None]
        r, c = np.nonzero(above)
        exact = np.empty(len(r))
        for i in range(0, len(r), PAIRS):
            some = slice(i, i + PAIRS)
            exact[some] = np.einsum("ij,ij->i", part[r[some]].astype(np.float64), base[c[some]].astype(np.float64))
        fine = exact >= least
        r, c, exact = r[fine], c[fine], exact[fine]
        order = np.lexsort((-exact, r))
        r, c, exact = r[order], c[order], exact[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[keep] + at, c[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


class MultiIndex:
    """Two codebooks, the number of entries per cell, and the block each cell is stored in."""

    def __init__(self, dim: int, first: np.ndarray, second: np.ndarray):
        self.dim, self.first, self.second = dim, first, second

    @classmethod
    def fit(cls, rows: DataFrame, dim: int, n: int, vector: str, key: str, centroids: int) -> MultiIndex | None:
        """Codebooks by k-means on each half of a sample of at most SAMPLE rows, chosen by the hash of their id; none without usable rows."""
        share = min(1.0, SAMPLE / max(n, 1))
        picked = rows.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        sample = unit_vectors(picked, dim, vector, key).limit(SAMPLE)

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    halves = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(h).ravel()), h.shape[1]).cast(pa.list_(pa.float32())) for h in _halves(_matrix(b, dim))]
                    yield pa.RecordBatch.from_arrays(halves, ["a", "b"])

        halves = sample.mapInArrow(parts, "a array<float>, b array<float>").select(array_to_vector("a").alias("a"), array_to_vector("b").alias("b")).repartition(4).persist()
        if halves.isEmpty():
            return None
        books = []
        for c in ("a", "b"):
            model = KMeans(k=centroids, featuresCol=c, predictionCol="p", maxIter=6, initSteps=1, seed=5).fit(halves)
            books.append(np.array(model.clusterCenters(), dtype=np.float32))
        halves.unpersist()
        return cls(dim, *books)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = _halves(x)
        return _distances(a, self.first).argmin(1) * len(self.second) + _distances(b, self.second).argmin(1)

    def store(self, counts: dict[int, int], most: int) -> None:
        """Group cells into blocks of at most `most` entries: from the fullest free cell on, the nearest to the block's mean.

        A cell that is larger than a block is a block of its own, cut into slices.
        """
        self.count = np.zeros(len(self.first) * len(self.second), dtype=np.int64)
        self.count[list(counts)] = list(counts.values())
        cells = np.flatnonzero(self.count)
        centres = np.concatenate([self.first[cells // len(self.second)], self.second[cells % len(self.second)]], axis=1)
        weight = self.count[cells]
        free = np.ones(len(cells), dtype=bool)
        self.block = np.full(len(self.count), -1, dtype=np.int64)
        self.slices: list[int] = []
        while free.any():
            i = int(np.where(free, weight, -1).argmax())
            size, mean, number = int(weight[i]), centres[i] * weight[i], len(self.slices)
            self.block[cells[i]] = number
            free[i] = False
            while size < most and free.any():
                d = ((centres - mean / size) ** 2).sum(1)
                d[~free | (weight + size > most)] = np.inf
                j = int(d.argmin())
                if not np.isfinite(d[j]):
                    break
                self.block[cells[j]] = number
                mean, size, free[j] = mean + centres[j] * weight[j], size + int(weight[j]), False
            self.slices.append(max(1, -(-size // most)))
        self.base = np.concatenate([[0], np.cumsum(self.slices)]).astype(np.int64)

    def probes(self, x: np.ndarray, wanted: int) -> list[list[int]]:
        """Per vector the blocks that hold the cells nearest to it, until those cells have `wanted` entries.

        Centroid pairs are taken from a heap by summed distance: both halves' centroids in order of distance, each
        pair followed by its right neighbour, and by its lower one from the first column.
        """
        a, b = _halves(x)
        da, db = _distances(a, self.first), _distances(b, self.second)
        oa, ob = da.argsort(1), db.argsort(1)
        sa, sb = np.take_along_axis(da, oa, 1).tolist(), np.take_along_axis(db, ob, 1).tolist()
        oa, ob = oa.tolist(), ob.tolist()
        k, width = len(self.first), len(self.second)
        count, block = self.count.tolist(), self.block.tolist()
        out = []
        for ra, rb, ia, ib in zip(sa, sb, oa, ob):
            heap, seen, found = [(ra[0] + rb[0], 0, 0)], 0, {}
            while heap and seen < wanted:
                _, i, j = heapq.heappop(heap)
                cell = ia[i] * width + ib[j]
                if count[cell]:
                    seen += count[cell]
                    found[block[cell]] = True
                if j + 1 < width:
                    heapq.heappush(heap, (ra[i] + rb[j + 1], i, j + 1))
                if j == 0 and i + 1 < k:
                    heapq.heappush(heap, (ra[i + 1] + rb[0], i + 1, 0))
            out.append(list(found))
        return out


def budget(n: int, reach: float) -> tuple[int, int]:
    """(entries of a block at most, entries to probe) for n vectors. Blocks are bounded; the probed share of n never falls, more blocks are probed."""
    share = max(BLOCK_LEAST, -(-n // BLOCK_SHARE))
    return min(BLOCK_MOST, share), max(1000, int(share * reach))


def copies(n: int, most: int, wanted: int, slices: int) -> int:
    """Of each slice, so that each answers about QUERIES_MOST queries at most: n vectors probe `wanted` entries each and their own slice."""
    return max(1, math.ceil((wanted + 2 * n / max(1, slices)) / QUERIES_MOST))


def _distinct(rows: DataFrame, dim: int, vector: str, key: str) -> DataFrame:
    """(h, vec): each distinct unit vector once."""
    units = unit_vectors(rows, dim, vector, key)
    return units.select(F.unhex(F.md5("vec")).alias("h"), "vec").dropDuplicates(["h"])


def nearest_distinct(rows: DataFrame, k: int, dim: int, vector: str, key: str, min_cosine: float, centroids: int, reach: float) -> DataFrame:
    """(h, nh, cosine): for each distinct vector (h, its digest) the k most similar other distinct ones."""
    spark: SparkSession = rows.sparkSession
    n = rows.count()
    index = MultiIndex.fit(rows, dim, n, vector, key, centroids)
    if index is None:
        return spark.createDataFrame([], "h binary, nh binary, cosine double")
    shared = spark.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.cells(_matrix(b, dim))), b.column("h")], ["cell", "h"])

    coded = unit_vectors(rows, dim, vector, key).select(F.unhex(F.md5("vec")).alias("h"), "vec").mapInArrow(code, "cell long, h binary")
    counts = dict(coded.distinct().groupBy("cell").count().collect())  # at most centroids^2 rows
    if not counts:
        return spark.createDataFrame([], "h binary, nh binary, cosine double")
    most, wanted = budget(sum(counts.values()), reach)
    index.store({int(c): int(m) for c, m in counts.items()}, most)
    parts = copies(sum(counts.values()), most, wanted, int(index.base[-1]))
    stored = spark.sparkContext.broadcast(index)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the slice of its block (kind 0, it is entry and query there), to the slice's other copies (kind 1,
        entry only), and as a query to the other slices it probes (kind 2). Which copy answers it depends on its digest."""
        ix = stored.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, dim)
            home = ix.block[ix.cells(x)]
            digest = np.array([int.from_bytes(h.as_py()[:6], "big") for h in b.column("h")])
            own, copy = digest % np.array(ix.slices)[home] + ix.base[home], (digest // 65_521 % parts).tolist()
            row, slot, kind = [], [], []
            for i, s in enumerate(own.tolist()):
                for c in range(parts):
                    row.append(i), slot.append(s * parts + c), kind.append(0 if c == copy[i] else 1)
            for i, blocks in enumerate(ix.probes(x, wanted)):
                for s in (s for q in {*blocks, int(home[i])} for s in range(ix.base[q], ix.base[q + 1])):
                    if s != own[i]:
                        row.append(i), slot.append(s * parts + copy[i]), kind.append(2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind, pa.int8()), b.column("h").take(take), b.column("vec").take(take)], ["slot", "kind", "h", "vec"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slice, entries first. Entries are kept (a slice at most), queries are answered as they come."""
        slot, ids, kept, base, asked = -1, [], [], None, 0

        def answer(qi: list, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(q), CHUNK):
                r, c, exact = best(q[at : at + CHUNK], base, k + 1, min_cosine)
                if not len(r):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([qi[at + i] for i in r], pa.binary()), pa.array([ids[j] for j in c], pa.binary()), pa.array(exact)], ["h", "nh", "cosine"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal base
            if kept and base is None:
                base = np.concatenate(kept)
                yield from answer(ids[:asked], base[:asked])

        for b in batches:
            if not b.num_rows:
                continue
            x, slots, kinds = _matrix(b, dim), b.column("slot").to_numpy(), b.column("kind").to_numpy()
            hs = b.column("h").to_pylist()
            cut = np.flatnonzero(np.diff(slots) | np.diff(kinds)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(x)]):
                if slots[lo] != slot:
                    yield from close()
                    slot, ids, kept, base, asked = slots[lo], [], [], None, 0
                if kinds[lo] < 2:
                    ids.extend(hs[lo:hi])
                    kept.append(x[lo:hi].copy())
                    asked += (hi - lo) * (kinds[lo] == 0)
                else:
                    yield from close()
                    if base is not None:
                        yield from answer(hs[lo:hi], x[lo:hi])
        yield from close()

    sent = _distinct(rows, dim, vector, key).mapInArrow(send, "slot int, kind byte, h binary, vec binary")
    placed = sent.repartitionById(int(index.base[-1]) * parts, "slot").sortWithinPartitions("slot", "kind")
    near = placed.mapInArrow(scan, "h binary, nh binary, cosine double").where("h <> nh")
    rank = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("cosine"), "nh"))
    return near.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, k: int = 10, dim: int = 384, vector: str = "embedding", key: str = "embedding_id", min_cosine: float = -2.0, centroids: int = CENTROIDS, reach: float = REACH) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar others of every usable vector, ties by id.

    Only neighbours of at least `min_cosine` come out; that is exact for what is left, since those rank first.
    Vectors that are null, of another length, not finite or all zero are left out, rows without an id too. Repeated rows
    count once; an id with several vectors counts with each of them and the best cosine. Equal vectors are searched once
    and share the result; of a group of equals each gets the first k others by id, so a group is never squared.
    Approximate: the codebooks come from a bounded sample, every vector is indexed, and the blocks that hold the cells
    nearest to a vector, up to `reach` sixteenths of all entries, are searched whole.
    """
    units = unit_vectors(rows, dim, vector, key).select("id", F.unhex(F.md5("vec")).alias("h")).distinct()
    by_id = Window.partitionBy("h").orderBy("id")
    firsts = units.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    near = nearest_distinct(rows, k, dim, vector, key, min_cosine, centroids, reach)
    far = near.join(firsts.withColumnRenamed("h", "nh"), "nh").select("h", F.struct("cosine", "ids").alias("n"))
    own = firsts.where(F.size("ids") > 1).select("h", F.struct(F.lit(1.0).alias("cosine"), "ids").alias("n"))
    lists = far.unionByName(own).groupBy("h").agg(F.collect_list("n").alias("ns"))  # at most k + 1 lists of k + 1 ids
    flat = F.flatten(F.transform("ns", lambda n: F.transform(n["ids"], lambda i: F.struct((-n["cosine"]).alias("d"), i.alias("id")))))
    lists = lists.select("h", F.slice(F.array_sort(flat), 1, k + 1).alias("best"))
    mine = skew_join(units, lists, "h")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    out = mine.select("id", F.posexplode(others).alias("rank", "b")).select("id", F.col("b.id").alias("neighbour"), (-F.col("b.d")).alias("cosine"), F.col("rank") + 1)
    return out.toDF("id", "neighbour", "cosine", "rank").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"), F.min("rank").alias("rank"))


def found(rows: DataFrame, min_cosine: float = 0.9) -> DataFrame:
    """(a_id, b_id), a_id < b_id: one is among the 10 most similar of the other, with a cosine of at least 0.9."""
    near = nearest(rows, min_cosine=min_cosine, reach=CLOSE_REACH)
    return near.select(F.least("id", "neighbour").alias("a_id"), F.greatest("id", "neighbour").alias("b_id")).distinct()

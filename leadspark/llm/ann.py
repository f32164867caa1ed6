"""Nearest neighbours by cosine through cross-polytope hashing.

Each of TABLES tables turns the unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and takes the nearest signed axis as a vector's bucket. A query probes the nearest axes in each table;
in each bucket probed, queries and vectors meet, and the exact cosine is taken of the vectors as they are.

The number of buckets and of probes follow the number of vectors n by one rule: an axis is appended to the bucket each
time n grows by the number of axes, and probes are fewer the denser the vectors lie. A bucket of more than CHUNK
vectors, or queries, is cut by hash into chunks, and each pair of chunks meets in a task of its own, so nothing is
dropped from a hot bucket. Of equal vectors only the k + 1 with the smallest ids can be an answer, so only
they are indexed. A query for which the probes find too few is searched again in all buckets.

Defined results: rows with a null id, and vectors null, empty, zero or with null or non-finite components, take no
part; shorter vectors are filled with zeros; repeated rows count once; ties go to the smaller id; rows with the
query's id are never its neighbours; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.cluster import ship
from leadspark.llm.common import materialise

#: Tables, probes in each where vectors lie dense, neighbours to return, vectors or queries in one chunk.
TABLES, PROBES, NEIGHBOURS, CHUNK = 8, 12, 5, 4096
#: Number of vectors up to which probes rise by the cube root, and from which a bucket has more than one axis.
DENSE, CROWDED = 38_000, 4096
SEED = 11


def valid(vector: Column) -> Column:
    value = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(v: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = v.shape
    step = 1
    while step < d:
        pairs = v.reshape(n, d // (2 * step), 2, step)
        v = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return v


@dataclass(frozen=True)
class Index:
    dimension: int  # a power of two
    axes: int  # axes of a bucket
    probes: int
    tables: int = TABLES

    @classmethod
    def of(cls, n: int, length: int, tables: int = TABLES, probes: int = PROBES) -> Index:
        d = 1 << max(1, (length - 1).bit_length())
        axes = max(1, int(math.log(max(n, 1) / CROWDED) / math.log(2 * d))) if n > CROWDED else 1
        wide = math.ceil(probes * max(1.0, (DENSE / max(n, 1)) ** (1 / 3)))
        return cls(d, axes, min((2 * d) ** axes, wide**axes), tables)

    def turned(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        signs = np.random.default_rng((SEED, table, axis)).choice((-1.0, 1.0), size=(3, self.dimension))
        for s in signs:
            x = hadamard(x * s)
        return x / self.dimension**1.5

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """For each row and table the `probes` nearest buckets, nearest first."""
        out = []
        for t in range(self.tables):
            numbers, losses = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for a in range(self.axes):
                y = self.turned(x, t, a)
                both = np.concatenate((y, -y), axis=1)  # signed axes
                m = min(2 * self.dimension, probes)
                near = np.argsort(-both, axis=1, kind="stable")[:, :m]
                loss = both.max(axis=1, keepdims=True) - np.take_along_axis(both, near, 1)
                numbers = (numbers[:, :, None] * (2 * self.dimension) + near[:, None, :]).reshape(len(x), -1)
                losses = (losses[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
                best = np.argsort(losses, axis=1, kind="stable")[:, :probes]
                numbers, losses = np.take_along_axis(numbers, best, 1), np.take_along_axis(losses, best, 1)
            out.append(numbers * self.tables + t)
        return np.stack(out, axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """The vectors, kept as doubles in bytes, as rows filled with zeros."""
    out = np.zeros((len(column), dimension))
    for i, v in enumerate(column):
        x = np.frombuffer(v.as_buffer(), np.float64)
        out[i, : len(x)] = x
    return out


def _hashed(rows: DataFrame, index: Index, probes: int) -> DataFrame:
    """rows (id, v as an array) with v as bytes, and a row for each bucket."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [np.asarray(v, np.float64) for v in batch.column("v").to_pylist()]
            x = np.zeros((len(raw), index.dimension))
            for i, v in enumerate(raw):
                x[i, : len(v)] = v
            x /= np.abs(x).max(axis=1, keepdims=True)  # no square overflows
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            found = index.buckets(x, probes).reshape(len(raw), -1)
            lists = pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in raw], pa.binary()), lists], ["id", "v", "buckets"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "id long, v binary, buckets array<long>").select("id", "v", F.explode("buckets").alias("bucket"))


def _chunked(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with chunk columns a and b: the left is cut into as many a as it needs and copied to each b, and the
    other way round."""
    size = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    cuts = size(left, "na").join(size(right, "nb"), "bucket")  # buckets with both
    cuts = materialise(cuts.where("na > 1 or nb > 1"), "ann-cuts")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("id"), one(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    l, r = left.join(cuts, "bucket", "left"), right.join(cuts, "bucket", "left")  # noqa: E741
    return l.select("id", "v", "bucket", own("na").alias("a"), copies("nb").alias("b")), r.select("id", "v", "bucket", copies("na").alias("a"), own("nb").alias("b"))


def _search(queries: DataFrame, vectors: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, vec_id, score: from each meeting of a chunk of queries and one of vectors, the k best of each query
    (and those that tie with the last)."""
    q, v = _chunked(queries, vectors)
    dimension = index.dimension

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, vi = left["id"].to_numpy(), right["id"].to_numpy()
        out = [[], [], []]
        if len(qi) and len(vi):
            a, b = _matrix(left["v"], dimension), _matrix(right["v"], dimension)
            an, bn = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            for start in range(0, len(qi), 256):
                part = slice(start, start + 256)
                cos = (a[part] / an[part, None]) @ (b / bn[:, None]).T
                cos[qi[part, None] == vi[None, :]] = -np.inf
                if len(vi) > k:
                    edge = np.partition(cos, len(vi) - k, axis=1)[:, len(vi) - k, None]
                else:
                    edge = np.full((len(cos), 1), -2.0)
                row, col = np.nonzero((cos >= edge - 1e-9) & np.isfinite(cos))
                x, y = a[part][row], b[col]  # row by row, so that equal vectors score the same everywhere
                out[0].append(qi[part][row])
                out[1].append(vi[col])
                out[2].append((x * y).sum(axis=1) / (an[part][row] * bn[col]))
        flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    keys = ["bucket", "a", "b"]
    met = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query: Column, k: int = NEIGHBOURS, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of the rows to each row that is_query (of the column `id`) picks."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    same = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    stored = materialise(rows.withColumn("same", same).where(F.col("same") <= k + 1).select("id", "v").distinct(), "ann-vectors")
    asked = materialise(rows.where(is_query).distinct(), "ann-queries")
    n, longest = stored.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    index = Index.of(n, longest, tables, probes)
    vectors = _hashed(stored, index, 1)
    found = materialise(_search(_hashed(asked, index, index.probes), vectors, index, k), "ann-found")
    others = stored.select("id").distinct().count() - 1
    short = found.groupBy("query_id").count().where(F.col("count") >= min(k, others)).select(F.col("query_id").alias("id"))
    short = materialise(asked.join(short, "id", "left_anti"), "ann-short")
    if not short.isEmpty():  # every bucket of one table
        whole = Index(index.dimension, 1, 2 * index.dimension, 1)
        again = _search(_hashed(short, whole, whole.probes), _hashed(stored, whole, 1), whole, k)
        ids = short.select(F.col("id").alias("query_id")).distinct()
        found = found.join(ids, "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("id") % 50 == 0)

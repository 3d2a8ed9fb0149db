"""Centroid clustering (Lloyd's rounds) with equal-average equal-variance search.

Vectors become integers, floor(SCALE * x), so that distances, sums and means are exact
and every run gives the same clusters. With S the sum of a vector's D components and
V = D * sum(x^2) - S^2 (D^2 times its variance), the squared distance d of a vector x and
a centroid c obeys

    D * d >= (S_x - S_c)^2 + (sqrt(V_x) - sqrt(V_c))^2.

The centroids stand sorted by S, that is by component mean. A vector's search starts at
its own mean and goes outward on both sides, always to the nearer mean next. As soon as
that mean alone is too far, all others are, too, and the search of the vector ends (equal
average); a centroid whose mean and deviation together are too far is passed over (equal
variance); only what is left is compared, in integers. Means are tested in integers and
deviations in doubles with a margin for rounding, and only what is strictly too far is
rejected, so ties are found and go to the smaller centroid number.

The centroids (k * dim integers) are the only thing that every task gets. A task adds up
its vectors per cluster, so a round shuffles one row per task, cluster and component
whatever the sizes of the clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalspark.llm.common import table
from evalspark.session import cut_lineage

SCALE = 64
DIM, K, ROUNDS = 64, 16, 3
SEED = 1
#: Integers beyond this size take no part: their squared distance might not fit a long.
LARGEST = 1 << 27
#: The centroids are sent to every task; more bytes than this are refused.
CENTROID_BYTES = 64 << 20
#: Vectors that are searched at once.
BLOCK = 4096


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, int64 matrix) of the usable vectors of a list column."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * SCALE)
        fit = (np.abs(x) <= LARGEST).all(axis=1)  # false for NaN and infinities (and for null, read as NaN)
    return rows[fit], x[fit].astype(np.int64)


class Centroids:
    """Centroids ``c`` [k, dim] with their means in order, ready for the search."""

    def __init__(self, c: np.ndarray):
        self.dim = c.shape[1]
        total = c.sum(axis=1)
        self.number = np.lexsort((np.arange(len(c)), total))
        self.c, self.total = c[self.number], total[self.number]
        self.deviation = self._deviation(self.c, self.total)

    def _deviation(self, x: np.ndarray, total: np.ndarray) -> np.ndarray:
        """sqrt(D * sum(x^2) - S^2): component deviation times D, as sqrt(D * sum((x - mean)^2)) in doubles."""
        spread = x - (total / self.dim)[:, None]
        return np.sqrt(self.dim * np.einsum("ij,ij->i", spread, spread))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid number, squared distance) of the nearest centroid per row of ``x``, and the distances computed."""
        n, k = len(x), len(self.c)
        total = x.sum(axis=1)
        deviation = self._deviation(x, total)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k)
        high = np.searchsorted(self.total, total)
        low = high - 1
        todo = np.arange(n)
        compared = 0
        while len(todo):
            below, above = low[todo], high[todo]
            gap_low = np.where(below >= 0, total[todo] - self.total[np.maximum(below, 0)], np.iinfo(np.int64).max)
            gap_high = np.where(above < k, self.total[np.minimum(above, k - 1)] - total[todo], np.iinfo(np.int64).max)
            down = gap_low <= gap_high
            gap, at = np.where(down, gap_low, gap_high), np.where(down, below, above)
            open_ = (gap < np.iinfo(np.int64).max) & ~_exceeds(gap, self.dim, best[todo])
            todo, at, gap, down = todo[open_], at[open_], gap[open_], down[open_]
            low[todo[down]] -= 1
            high[todo[~down]] += 1
            apart = np.abs(deviation[todo] - self.deviation[at])
            apart = np.maximum(0.0, apart - 1e-9 * (deviation[todo] + self.deviation[at] + 1))  # rounding of the deviations
            far = (gap.astype(np.float64) ** 2 + apart ** 2) * (1 - 1e-9) > self.dim * best[todo].astype(np.float64)
            near, to = todo[~far], at[~far]
            compared += len(near)
            apart = x[near] - self.c[to]
            d = np.einsum("ij,ij->i", apart, apart)
            closer = (d < best[near]) | (d == best[near]) & (self.number[to] < number[near])
            near, to, d = near[closer], to[closer], d[closer]
            best[near], number[near] = d, self.number[to]
        return number, best, compared


def _exceeds(gap: np.ndarray, dim: int, best: np.ndarray) -> np.ndarray:
    """gap^2 > dim * best, exact: doubles hold both sides up to 2^53, beyond it Python's integers decide close cases."""
    a, b = gap.astype(np.float64) ** 2, dim * best.astype(np.float64)
    out = a > b
    close = np.flatnonzero((np.abs(a - b) <= 1e-12 * (a + b)) & (np.maximum(a, b) >= 2.0 ** 53))
    for i in close.tolist():
        out[i] = int(gap[i]) ** 2 > dim * int(best[i])
    return out


def blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_id, integer matrix) of the usable vectors, at most BLOCK at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            rows, x = integers(part.column("embedding"), dim)
            if len(rows):
                yield part.column("vec_id").take(pa.array(rows)), x


def readable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` with an embedding of floats or doubles, which numpy reads as they are."""
    kind = vectors.schema["embedding"].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding") if plain else F.col("embedding").cast("array<double>").alias("embedding"))


def first_centroids(vectors: DataFrame, k: int, dim: int) -> np.ndarray:
    """The ``k`` usable vectors with the smallest SHA-256 of ``SEED:<vec_id>``, in that order (ties: smaller components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []  # at most k of them
        for ids, x in blocks(batches, dim):
            new = [(hashlib.sha256(f"{SEED}:{i}".encode()).hexdigest(), j) for j, i in enumerate(ids.to_pylist()) if i is not None]
            new = sorted(new)
            edge = new[min(k, len(new)) - 1][0] if new else ""
            best = sorted(best + [(h, x[j].tolist()) for h, j in new if h <= edge])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))],
                                         ["hash", "c"])

    rows = vectors.mapInArrow(run, "hash string, c array<long>").orderBy("hash", "c").limit(k).collect()
    return np.array([r["c"] for r in rows], np.int64).reshape(-1, dim)


def moved(vectors: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors; those without vectors stay."""
    dim = c.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(shared.value)
        k = len(shared.value)
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x in blocks(batches, dim):
            number, _, _ = centroids.search(x)
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
            total[number[order][first]] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(number, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dim)), pa.array(np.tile(np.arange(dim), len(some))),
             pa.array(total[some].ravel()), pa.array(np.repeat(count[some], dim))], ["cluster", "pos", "total", "n"])

    sums = (vectors.mapInArrow(run, "cluster long, pos long, total long, n long").groupBy("cluster", "pos")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")))
    out = c.copy()
    for r in sums.collect():  # k * dim rows at most
        out[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    return out


def assigned(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every usable vector."""
    dim = c.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(shared.value)
        for ids, x in blocks(batches, dim):
            number, distance, _ = centroids.search(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """Clusters of ``vectors(vec_id, embedding)``: assignments ``(vec_id, cluster, distance)`` and centroids ``(cluster, centroid)``.

    A vector takes part if it has exactly ``dim`` components, none of them null or
    non-finite, and none whose integer is beyond LARGEST (two million at SCALE 64).
    Repeated rows are vectors of their own; a null vec_id is assigned but starts no
    centroid. With fewer vectors than ``k`` there are as many centroids; an empty
    table has none, and no assignments.
    """
    spark = vectors.sparkSession
    vectors = readable(vectors)
    if k * dim * 8 > CENTROID_BYTES:
        raise ValueError(f"{k} centroids of {dim} components pass {CENTROID_BYTES} bytes")
    c = first_centroids(vectors, k, dim)
    for _ in range(rounds if len(c) else 0):
        c = moved(vectors, c)
    centroids = spark.createDataFrame([(i, row) for i, row in enumerate(c.tolist())], "cluster int, centroid array<long>")
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    return assigned(vectors, c), centroids


def described(found: DataFrame, centroids: DataFrame) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256; an inertia that no long holds is null."""
    found = cut_lineage(found)
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    whole = per.agg(F.sum("part").alias("whole"))
    names = (centroids.join(per, "cluster").crossJoin(whole)  # one row
             .select("cluster", F.expr("try_cast(part AS long)").alias("cluster_inertia"), F.expr("try_cast(whole AS long)").alias("inertia"),
                     F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")))
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: 16 clusters of the embeddings after three rounds."""
    return described(*cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """The same clusters in DuckDB SQL, every vector compared with every centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT p.rid, c.cluster, sum((p.v - c.v) * (p.v - c.v)) AS d FROM parts p JOIN c{r} c USING (pos) GROUP BY ALL)
  GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.pos, coalesce(m.v, c.v) AS v
  FROM c{r} c LEFT JOIN (
    SELECT cluster, pos, CAST((s - (((s % n) + n) % n)) // n AS BIGINT) AS v
    FROM (SELECT cluster, pos, sum(p.v) AS s, count(*) AS n FROM parts p JOIN a{r} USING (rid) GROUP BY ALL)) m USING (cluster, pos))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(floor({SCALE} * x::DOUBLE)) <= {LARGEST})) = {dim}),
parts AS MATERIALIZED (SELECT rid, unnest(range({dim})) AS pos, unnest(v)::BIGINT AS v FROM kept),
firsts AS (
  SELECT rid, row_number() OVER (ORDER BY h, v) - 1 AS cluster
  FROM (SELECT rid, v, sha256('{SEED}:' || vec_id) AS h FROM kept WHERE vec_id IS NOT NULL) QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, pos, v FROM firsts JOIN parts USING (rid)),{",".join(steps)},
names AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN names USING (cluster)
"""

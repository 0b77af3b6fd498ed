"""Centroid clustering of integer vectors with exact results: float32 screening inside rigorous rounding-error intervals.

Every round a task multiplies a batch of vectors with the few centroids in float32. By the standard bound of an inner product of n terms, in
any order of summation, the error is at most gamma(n) * |x| * |c| with gamma(n) = n u / (1 - n u), u = 2^-24; two more terms cover the
rounding of the components. That gives an interval round |c|² - 2 x·c for each centroid (|x|² is common to all). Where one
interval lies wholly below the others its centroid is the nearest; where intervals overlap, the centroids that may be nearest are compared by exact
integers and the lowest number wins. Sums of a cluster are exact integers: one row a task and cluster is shuffled, and the centroids,
``k`` rows, are all that comes to the driver.

Defined results: vectors of another length, or with null or non-finite components, take no part; a null vec_id takes part and is a start only
after all ids; rows that repeat a vec_id are vectors of their own; fewer vectors than ``k`` give as many centroids; no vectors, no rows. Integers beyond
2^26 in size (components beyond 65,536) are held there, so that squared distances fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import saved, table

WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
MOST = 1 << 26
UNIT = 2.0 ** -24


def whole(vectors: DataFrame, column: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of integers) of the vectors that take part."""
    x = F.col(column).cast("array<double>")
    fits = (F.size(x) == width) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    held = lambda c: F.greatest(F.lit(-MOST).cast("double"), F.least(F.lit(MOST).cast("double"), F.floor(c * scale).cast("double"))).cast("int")
    return vectors.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: held(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c)))).alias("v"))


def starts(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids hash smallest; each partition keeps its own ``k``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", h.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, vectors compared exactly) of integer vectors x against integer centroids c."""
    n = x.shape[1]
    gamma = (n + 2) * UNIT / (1 - (n + 2) * UNIT)
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    xd, cd = x.astype(np.float64), c.astype(np.float64)
    norms = np.sqrt((xd * xd).sum(1)) * (1 + 1e-9), np.sqrt((cd * cd).sum(1)) * (1 + 1e-9)
    mid = (c * c).sum(1).astype(np.float64) - 2 * dot
    # the second term covers the float64 arithmetic of mid and of the bounds themselves
    err = 2 * gamma * norms[0][:, None] * norms[1][None] * (1 + 1e-6) + (np.abs(mid) + norms[1][None] ** 2 + 1) * 1e-14
    may = mid - err <= (mid + err).min(1, keepdims=True)
    best = may.argmax(1)
    several = np.flatnonzero(may.sum(1) > 1)
    for at in np.array_split(several, max(1, -(-len(several) // 4096))):
        exact = np.stack([((x[at] - c[j]) ** 2).sum(1) for j in range(len(c))], 1)
        exact[~may[at]] = np.iinfo(np.int64).max
        best[at] = exact.argmin(1)
    return best, ((x - c[best]) ** 2).sum(1), len(several)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.int64)


def moved(vectors: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids of the next round: exact sums over clusters, floors towards minus infinity."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(c.shape, dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                best = nearest(x, c)[0]
                for j in range(len(c)):
                    own = x[best == j]
                    total[j] += own.sum(0)
                    count[j] += len(own)
        keep = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(keep, pa.int32()), "n": pa.array(count[keep], pa.int64()), "s": pa.array(total[keep].tolist(), pa.list_(pa.int64()))})

    parts = vectors.select("v").mapInArrow(sums, "cluster int, n long, s array<long>")
    each = parts.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    out = c.copy()
    for r in each.collect():  # one row a centroid and component
        out[r.cluster, r.i] = int(r.s) // r.n
    return out


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after ``rounds`` rounds over vectors (vec_id, v); rounds that would change nothing are not run."""
    c = starts(vectors, k, seed)
    for _ in range(rounds if len(c) else 0):
        last, c = c, moved(vectors, c)
        if (last == c).all():
            break
    return c


def assigned(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance, _ = nearest(_matrix(batch), c)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, column: str = "embedding", width: int = WIDTH, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of every vector that takes part."""
    spark = vectors.sparkSession
    own = saved(whole(vectors, column, width, scale), "integers")
    c = fit(own, k, rounds, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    found = saved(assigned(own, c), "assigned")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one a centroid
    rows = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest(), c[j].tolist()) for j in sorted(sums)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def oracle(rounds: int = ROUNDS) -> str:
    near = """a{r} as materialized (select vec_id, v, d[1] as distance, d[2] as cluster from (select vec_id, v,
      (select min([list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])))::bigint, c.cluster]) from c{r} c) as d from kept))"""
    steps = []
    for r in range(rounds):
        steps += [near.format(r=r), f"""s{r} as (select cluster, i, sum(x)::bigint as s, count(*)::bigint as n from (select cluster, unnest(v) as x, unnest(range(1, 65)) as i from a{r}) group by cluster, i),
m{r} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as v from s{r} group by cluster),
c{r + 1} as materialized (select cluster, coalesce(m{r}.v, c{r}.v) as v from c{r} left join m{r} using (cluster))"""]
    steps.append(near.format(r=rounds))
    body = ",\n".join(steps)
    return f"""
with kept as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = 64),
c0 as materialized (select row_number() over (order by h) - 1 as cluster, v from (select v, sha256('3:' || vec_id) as h from kept order by h limit 8)),
{body},
i as (select cluster, sum(distance)::bigint as cluster_inertia from a{rounds} group by cluster)
select vec_id, a.cluster::int as cluster, distance, cluster_inertia, (select sum(distance)::bigint from a{rounds}) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join i using (cluster) join c{rounds} c using (cluster)"""


ORACLE = oracle()

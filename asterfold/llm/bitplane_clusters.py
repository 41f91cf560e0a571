"""Centroid clustering of integer vectors as bit planes: AND and popcount give exact dot products and distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import staged

#: Components of a vector: a plane holds one bit of each in a 64-bit word.
WIDTH = 64
#: Largest size of a component as an integer, so that a squared distance fits a long.
MOST = 1 << 27
#: Vectors whose planes are combined at once.
CHUNK = 2_048


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(n, planes) words of (n, WIDTH) integers in two's complement: bit i of word p is bit p of component i."""
    out = np.empty((len(values), planes), "<u8")
    for p in range(planes):
        bits = ((values >> p) & 1).astype("u1")
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights(planes: int) -> np.ndarray:
    """What a set bit of each plane adds: the highest plane is the sign's."""
    out = 1 << np.arange(planes, dtype="int64")
    out[-1] = -out[-1]
    return out


def dots(vectors: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact dot products of (n, B) planes with one vector's (B,) planes, or row by row with (n, B)."""
    w = weights(vectors.shape[1])
    both = vectors[:, :, None] & (other[None, None, :] if other.ndim == 1 else other[:, None, :])
    return np.bitwise_count(both).reshape(len(vectors), -1).astype("int64") @ np.outer(w, w).ravel()


def component_sums(vectors: np.ndarray) -> np.ndarray:
    """The sum of each component over (n, B) planes: counts of set bits by place, weighed by plane."""
    bits = np.unpackbits(vectors.view("u1").reshape(len(vectors), vectors.shape[1], 8), axis=2, bitorder="little")
    return weights(vectors.shape[1]) @ bits.sum(axis=0, dtype="int64")


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
    best, least = np.zeros(len(vectors), "i4"), np.full(len(vectors), np.iinfo("int64").max)
    for k, c in enumerate(centroids):
        own = int(dots(c[None, :], c)[0])
        far = norms + own - 2 * dots(vectors, c)
        closer = far < least
        best[closer], least[closer] = k, far[closer]
    return best, least


@dataclass(frozen=True)
class Packed:
    """vectors: vec_id, planes (their words as bytes), norm (the vector's dot product with itself)."""

    vectors: DataFrame
    planes: int


def packed(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> Packed:
    """Vectors of WIDTH components, none null, NaN or infinite, as planes of floor(scale * x), written once.

    Others are left out; null ids and repeated rows stay. A component of more than MOST raises.
    """
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size(v) == WIDTH) & F.coalesce(fine, F.lit(False)))
    low, high = rows.agg(F.min(F.array_min(v)), F.max(F.array_max(v))).first()
    low, high = (float(np.floor(scale * (x or 0.0))) for x in (low, high))
    if max(-low, high) > MOST:
        raise ValueError(f"a component is larger than {MOST} / {scale}")
    planes = 1 + max(int(high).bit_length(), int(-low - 1).bit_length() if low < 0 else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            words = pack(np.floor(scale * x).astype("int64"), planes)
            norm = np.concatenate([dots(words[k : k + CHUNK], words[k : k + CHUNK]) for k in range(0, len(words), CHUNK)] or [np.empty(0, "int64")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(norm)], ["vec_id", "planes", "norm"])

    return Packed(staged(rows.mapInArrow(run, "vec_id long, planes binary, norm long"), "planes"), planes)


def unpack(words: np.ndarray) -> np.ndarray:
    """The components of (n, B) planes."""
    return np.stack([component_sums(w[None, :]) for w in words]) if len(words) else np.empty((0, WIDTH), "int64")


def words_of(column: pa.Array, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, planes)


def seeds(data: Packed, k: int, seed: int) -> np.ndarray:
    """Components of the k vectors of the smallest SHA-256 of "seed:id"; ties by their planes, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = data.vectors.select(h.alias("h"), "planes").orderBy(F.col("h").asc_nulls_last(), "planes").limit(k).collect()
    return unpack(np.frombuffer(b"".join(bytes(r.planes) for r in rows), "<u8").reshape(-1, data.planes))


def cluster_totals(data: Packed, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """(vectors, summed distance, summed components) by number of the nearest centroid: a row a task and cluster is shuffled."""
    shared, planes = pack(centroids, data.planes), data.planes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(len(shared), "int64"), np.zeros(len(shared), "int64"), np.zeros((len(shared), WIDTH), "int64")
        for batch in batches:
            words, norms = words_of(batch.column(0), planes), batch.column(1).to_numpy()
            for low in range(0, len(words), CHUNK):
                some = words[low : low + CHUNK]
                best, far = nearest(some, norms[low : low + CHUNK], shared)
                for c in np.unique(best):
                    mine = best == c
                    n[c] += mine.sum()
                    inertia[c] += far[mine].sum()
                    sums[c] += component_sums(some[mine])
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype("i4")), pa.array(n[met]), pa.array(inertia[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "inertia", "sums"])

    parts = data.vectors.select("planes", "norm").mapInArrow(run, "cluster int, n long, inertia long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("sums")[i]) for i in range(WIDTH)]).alias("sums"))
    return {r.cluster: (r.n, r.inertia, list(r.sums)) for r in total.collect()}


def fit(data: Packed, k: int, rounds: int, seed: int) -> np.ndarray:
    """Final centroids. A round moves each non-empty centroid to the exact floor of its vectors' mean.

    Rounds end early where none has moved, as all further ones would be alike. The driver sees k rows a round.
    """
    centroids = seeds(data, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (n, _, sums) in cluster_totals(data, centroids).items():
            moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assign(data: Packed, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    totals, planes, shared = cluster_totals(data, centroids) if len(centroids) else {}, data.planes, pack(centroids, data.planes)
    inertia = np.array([totals[c][1] if c in totals else 0 for c in range(len(shared))], "int64")
    sha = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, norms = words_of(batch.column(1), planes), batch.column(2).to_numpy()
            for low in range(0, len(words), CHUNK):
                best, far = nearest(words[low : low + CHUNK], norms[low : low + CHUNK], shared)
                whole = np.full(len(best), inertia.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low : low + CHUNK], pa.array(best), pa.array(far), pa.array(inertia[best]), pa.array(whole), sha.take(pa.array(best))],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return data.vectors.select("vec_id", "planes", "norm").mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k-means of the vectors that packed() keeps: every vector with its cluster, exact in integers.

    Fewer than k vectors give fewer clusters, none no rows. Vectors alike are as many rows; columns other than id and
    vector are not read.
    """
    data = packed(vectors, scale, id_col, vector_col)
    return assign(data, fit(data, k, rounds, seed))


def op12_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(k: int = 8, rounds: int = 10) -> str:
    """The same in DuckDB, round by round."""
    floored = "case when s < 0 and s % n <> 0 then s // n - 1 else s // n end"
    steps = [
        f"kept as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(cast(x as double)))) = {WIDTH})",
        f"cells as materialized (select vec_id, unnest(range({WIDTH})) as i, unnest(v) as x from kept)",
        f"c0 as materialized (select k, unnest(range({WIDTH})) as i, unnest(v) as x from (select v, row_number() over (order by sha256('3:' || vec_id)) - 1 as k from kept qualify k < {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} as materialized (select vec_id, k, cast(sum((a.x - b.x) * (a.x - b.x)) as bigint) as d from cells a join c{r} b using (i) group by vec_id, k)")
        steps.append(f"a{r} as materialized (select vec_id, k, d from d{r} qualify row_number() over (partition by vec_id order by d, k) = 1)")
        if r < rounds:
            steps.append(f"m{r} as materialized (select k, i, cast(sum(x) as bigint) as s, count(*) as n from a{r} join cells using (vec_id) group by k, i)")
            steps.append(f"c{r + 1} as materialized (select c.k, c.i, case when n is null then c.x else {floored} end as x from c{r} c left join m{r} using (k, i))")
    last = f"a{rounds}"
    return (
        f"with {', '.join(steps)}, sums as (select k, cast(sum(d) as bigint) as own from {last} group by k), "
        f"named as (select k, sha256(string_agg(cast(x as varchar), ',' order by i)) as h from c{rounds} group by k) "
        f"select vec_id, cast(k as integer) as cluster, d as distance, own as cluster_inertia, cast((select sum(d) from {last}) as bigint) as inertia, h as centroid_sha256 from {last} join sums using (k) join named using (k)"
    )

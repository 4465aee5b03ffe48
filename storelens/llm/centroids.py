"""Centroid clustering on bit planes.

Every component becomes an integer. Plane k of a vector is one 64-bit word with
bit k of all 64 components, the last plane being the sign of two's complement.
The dot product of two vectors is the sum, over pairs of planes, of the number
of bits both have times the planes' weights: exact, without a multiplication
per component. A squared distance follows from three dot products. Sums of
vectors for the next centroids are counts of set bits by position and plane.

Vectors are packed once and written to the checkpoint folder; each round reads
the planes and sends one row per task and centroid. On the driver are only the
centroids: `clusters` times 64 integers.

Kept are vectors of exactly 64 components, none null or not finite; all other
rows, null vectors too, are in no cluster and not returned. Repeated rows count
each. A row without an id draws its start as if its id were the empty text; ties
in the draw go to the smaller id, ties in distance to the smaller cluster. With
fewer vectors than clusters there are as many clusters as vectors; an empty table
gives an empty result. Components beyond 2^25 in size after scaling are an error,
as 64-bit distances could not hold them. Of other columns only the id is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed

SIZE = 64
LARGEST = 1 << 25
RESULT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@dataclass(frozen=True)
class Setting:
    clusters: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"


def planes_of(values: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) words of the planes of (rows, 64) integers."""
    bits = (values[:, None, :] >> np.arange(count)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def plane_weights(count: int) -> np.ndarray:
    weights = np.left_shift(1, np.arange(count, dtype=np.int64))
    weights[-1] *= -1
    return weights


def dots(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Dot products of the vectors of (planes, rows) words with one vector's planes, or with as many vectors'."""
    last = len(weights) - 1
    # Pairs of planes of one weight are counted together; pairs with one sign plane weigh negatively.
    plus, minus = ({s: 0 for s in range(2 * last + 1)} for _ in range(2))
    for j in range(last + 1):
        for k in range(last + 1):
            counts = plus if (j == last) == (k == last) else minus
            counts[j + k] = np.add(counts[j + k], np.bitwise_count(a[j] & b[k]), dtype=np.int32)
    out = np.zeros(a.shape[1], np.int64)
    for s in range(2 * last + 1):
        out += (np.int64(1) << np.int64(s)) * (np.asarray(plus[s], np.int64) - minus[s])
    return out


def distances(planes: np.ndarray, centres: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, centres) squared distances of (rows, planes) words."""
    columns, middle = np.ascontiguousarray(planes.T), np.ascontiguousarray(centres.T)
    own, at = dots(columns, columns, weights), dots(middle, middle, weights)
    return np.stack([own - 2 * dots(columns, c, weights) + n for c, n in zip(centres, at.tolist())], axis=1)


def sums(planes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Componentwise sums of the rows."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little")
    return weights @ bits.sum(axis=0, dtype=np.int64).reshape(len(weights), SIZE)


def usable(vector: Column) -> Column:
    """Exactly 64 components, none null, not a number or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == SIZE) & finite, F.lit(False))


def integers(frame: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """`_key` and `_values`, the scaled components rounded down, of usable vectors."""
    kept = frame.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where(usable(F.col("_vector")))
    scaled = F.transform("_vector", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return kept.select("_key", scaled.alias("_values"))


def _starts(values: DataFrame, setting: Setting) -> list[list[int]]:
    name = F.sha2(F.concat(F.lit(f"{setting.seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256)
    rows = values.withColumn("_name", name).orderBy("_name", "_key", "_values").limit(setting.clusters).collect()
    return [r["_values"] for r in rows]


def _mapped(frame: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow over whole batches; `step` gives a batch's columns."""

    def run(parts):
        for part in parts:
            if part.num_rows:
                yield pa.RecordBatch.from_pydict(step(part))

    return frame.mapInArrow(run, schema)


def _assigned(packed: DataFrame, centres: list[list[int]], count: int, kind: str) -> DataFrame:
    """`_key`, `cluster` and `distance` of every packed vector."""
    weights = plane_weights(count)
    middle = planes_of(np.array(centres, np.int64), count)

    def step(part):
        found = distances(_words(part, count), middle, weights)
        nearest = found.argmin(axis=1)
        least = found[np.arange(len(found)), nearest]
        return {"_key": part.column("_key"), "cluster": nearest.astype(np.int32), "distance": least}

    return _mapped(packed, f"_key {kind}, cluster int, distance long", step)


def _words(part, count: int) -> np.ndarray:
    flat = part.column("_planes").flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(-1, count)


def _moved(packed: DataFrame, centres: list[list[int]], count: int) -> list[list[int]]:
    """The centroids after one round; a task sends one row per centroid it has vectors of."""
    weights = plane_weights(count)
    middle = planes_of(np.array(centres, np.int64), count)

    def run(batches):
        # The last column counts the vectors.
        total = np.zeros((len(centres), SIZE + 1), np.int64)
        for part in batches:
            words = _words(part, count)
            nearest = distances(words, middle, weights).argmin(axis=1)
            for c in np.unique(nearest):
                total[c, :SIZE] += sums(words[nearest == c], weights)
                total[c, SIZE] += (nearest == c).sum()
        cluster, place = np.indices(total.shape)
        met = (total[cluster, SIZE] > 0).ravel()
        yield pa.RecordBatch.from_pydict(
            {"cluster": cluster.ravel()[met], "place": place.ravel()[met], "total": total.ravel()[met]}
        )

    parts = packed.mapInArrow(run, "cluster long, place long, total long")
    # At most one row a component of a centroid. Decimals, as the sums of all vectors may leave 64 bits.
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    whole = {(r["cluster"], r["place"]): int(r["total"]) for r in found}
    return [
        [whole[c, i] // whole[c, SIZE] for i in range(SIZE)] if (c, SIZE) in whole else list(old)
        for c, old in enumerate(centres)
    ]


def clusters(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", setting: Setting = Setting()) -> DataFrame:
    """Key, `cluster`, squared `distance`, `cluster_inertia`, `inertia` and `centroid_sha256` of kept vectors."""
    if key in RESULT:
        raise ValueError(f"a key column named {key} clashes with the result's")
    values = integers(frame, key, vector, setting.scale)
    kind = dict(values.dtypes)["_key"]
    largest = values.agg(F.max(F.greatest(F.array_max("_values"), -F.array_min("_values")))).first()[0] or 0
    if largest > LARGEST:
        raise ValueError(f"a scaled component of size {largest} is beyond {LARGEST}")
    count = int(largest).bit_length() + 1

    def step(part):
        own = part.column("_values").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        words = planes_of(own, count).view(np.int64).ravel()
        ends = np.arange(0, len(words) + 1, count, dtype=np.int32)
        return {"_key": part.column("_key"), "_planes": pa.ListArray.from_arrays(pa.array(ends), pa.array(words))}

    packed = checkpointed(_mapped(values, f"_key {kind}, _planes array<long>", step))
    centres = _starts(values, setting)
    for _ in range(setting.rounds if centres else 0):
        centres = _moved(packed, centres, count)
    if not centres:
        found = packed.select("_key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = _assigned(packed, centres, count, kind)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        for c, x in enumerate(centres)
    ]
    listed = frame.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(listed), "cluster").select(
        F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

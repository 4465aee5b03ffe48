"""Importance resampling towards a target distribution, with exact ranks.

A document's features are its word runs of 1 to `longest` words, hashed into
buckets. Arrays over the buckets hold how often all documents and all target
texts use each, hence what a feature gains; a document's weight is the floored
mean gain of its features, and a Gumbel number drawn from its id turns the best
scores into a sample without replacement.

Ranks come from parallel sorting by regular sampling. The runs of scored rows
are sorted where they are; every `step`-th row of each is a regular sample, and
evenly spaced samples are the splitters. Rows go to the segment between their
splitters, are merged there, and the segments' counts, added up, tell where the
numbering of each begins. Segments beyond the last drawn rank are not exchanged.

A null text has no words: weight 0, never drawn. Words are runs of letters,
digits and characters beyond ASCII, A-Z lower-cased. Ties in score go to the
smaller id, rows without an id last; rows equal in both, repeated ids, are
ordered by weight and number of features. A row without an id draws its number
as if the id were the empty text. Empty tables give an empty result, or gains of
the documents alone. Of other columns only id and text are read; an id column
named like a result column is an error.

On the driver are the bucket counts, SAMPLES samples and one splitter and one
count per SEGMENT_ROWS rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import TABLE_ENTRIES, ascii_words, batches, checkpointed

# Regular samples on the driver at most (besides one a run), and rows of a segment.
SAMPLES = 1 << 18
SEGMENT_ROWS = 1 << 22
RESULT = ("n_features", "weight", "score", "rank")


@dataclass(frozen=True)
class Setting:
    longest: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10


class Buckets:
    """Bucket of a feature, kept in a bounded table."""

    def __init__(self, setting: Setting):
        self.longest, self.buckets = setting.longest, setting.buckets
        self.table: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        """Buckets of all runs of 1 to `longest` words."""
        runs = words
        if self.longest > 1:
            runs = [b" ".join(words[i : i + n]) for n in range(1, self.longest + 1) for i in range(len(words) - n + 1)]
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        table = self.table
        for run in set(runs).difference(table):
            table[run] = zlib.crc32(run) % self.buckets
        return np.fromiter(map(table.__getitem__, runs), np.int64, len(runs))


def bucket_counts(texts: DataFrame, setting: Setting, text: str = "text") -> np.ndarray:
    """How often the features of all texts fall into each bucket; a task sends one row per bucket it met."""

    def run(parts):
        buckets, total = Buckets(setting), np.zeros(setting.buckets, np.int64)
        for part in parts:
            for x in part.column("_text").to_pylist():
                total += np.bincount(buckets.of(ascii_words(x or "")), minlength=setting.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})

    counted = texts.select(F.col(text).alias("_text")).mapInArrow(run, "bucket long, n long")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row a bucket
    out = np.zeros(setting.buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, by bucket."""
    size = len(source)
    all_source, all_target = int(source.sum()) + size, int(target.sum()) + size
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log(((t + 1) * all_source) / ((s + 1) * all_target))) for s, t in pairs], np.int64)


def gumbel(name: str) -> int:
    """Thousandths of a Gumbel number, floored, from the first 32 bits of a name's SHA-256."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, setting: Setting, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_key`, `n_words`, `n_features`, `weight` and `score` of every row."""
    own = docs.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("_name"), F.col(text).alias("_text"))
    kind = dict(own.dtypes)["_key"]
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def each():
        buckets = Buckets(setting)

        def step(part):
            words = [ascii_words(x or "") for x in part.column("_text").to_pylist()]
            features = [buckets.of(x) for x in words]
            weights = [int(sent.value[x].sum()) // len(x) if len(x) else 0 for x in features]
            drawn = [gumbel(f"{setting.seed}:{x or ''}") for x in part.column("_name").to_pylist()]
            yield {
                "_key": part.column("_key"), "n_words": [len(x) for x in words],
                "n_features": [len(x) for x in features], "weight": weights, "score": [a + b for a, b in zip(weights, drawn)],
            }

        return step

    return batches(own, f"_key {kind}, n_words long, n_features long, weight long, score long", each)


def _order() -> list[Column]:
    return [F.desc("score"), F.col("_key").asc_nulls_last(), F.desc("weight"), F.desc("n_features")]


def splitters(rows: DataFrame, count: int, segments: int) -> list[tuple]:
    """At most `segments` - 1 (score, key) pairs from the regular samples of the locally sorted runs."""
    step = max(1, math.ceil(count / SAMPLES))
    runs = rows.sortWithinPartitions(*_order()).select("score", "_key")

    def run(parts):
        at = 0
        for part in parts:
            yield part.take(pa.array(np.arange(-at % step, part.num_rows, step), pa.int64()))
            at += part.num_rows

    samples = runs.mapInArrow(run, runs.schema).toArrow().to_pylist()
    ordered = sorted(((x["score"], x["_key"]) for x in samples), key=lambda x: _place(*x))
    return list(dict.fromkeys(ordered[len(ordered) * i // segments] for i in range(1, segments))) if ordered else []


def _placed(rows: DataFrame, cuts: list[tuple], least_words: int) -> DataFrame:
    """`rows` with `_segment`, the number of splitters that a row stands behind or on; null if it cannot be drawn."""
    ends, names = [_place(*c) for c in cuts], rows.columns

    def each():
        def step(part):
            own = zip(*(part.column(c).to_pylist() for c in ("n_words", "score", "_key")))
            found = [bisect_right(ends, _place(score, key)) if words >= least_words else None for words, score, key in own]
            yield {**{c: part.column(c) for c in names}, "_segment": found}

        return step

    return batches(rows, _schema(rows, "_segment int"), each)


def _place(score: int, key) -> tuple:
    """Sorts as _order() does."""
    return (-score, key is None, 0 if key is None else key)


def _schema(rows: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), more])


def ranked(rows: DataFrame, setting: Setting, segment_rows: int | None = None) -> DataFrame:
    """`rows` of scored() with `rank`: 1 for the best, null for what is not drawn.

    `rows` must give the same rows again when read again, as a checkpoint does.
    """
    drawable = rows.where(F.col("n_words") >= setting.least_words)
    count = drawable.count()
    quota = count * setting.percent // 100
    segments = max(1, math.ceil(count / (segment_rows or SEGMENT_ROWS)))
    cuts = splitters(drawable, count, segments) if segments > 1 else []
    placed = _placed(rows, cuts, setting.least_words)

    sizes = dict(placed.where("_segment is not null").groupBy("_segment").count().collect())  # one row a segment
    begins, at = {}, 0
    for segment in range(len(cuts) + 1):
        begins[segment] = at
        at += sizes.get(segment, 0)
    reached = [s for s, begin in begins.items() if begin < quota]
    last, names = max(reached, default=-1), rows.columns

    def run(parts):
        segment, number = None, 0
        for part in parts:
            ranks = []
            for own in part.column("_segment").to_pylist():
                if own != segment:
                    segment, number = own, begins[own]
                number += 1
                ranks.append(number if number <= quota else None)
            columns = [*(part.column(c) for c in names), pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "rank"])

    exchanged = placed.where(F.col("_segment") <= last).repartitionById(max(1, last + 1), F.col("_segment"))
    merged = exchanged.sortWithinPartitions("_segment", *_order()).mapInArrow(run, _schema(rows, "rank long"))
    others = placed.where(F.coalesce(F.col("_segment") > last, F.lit(True))).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(others)


def resample(docs: DataFrame, target: DataFrame, setting: Setting = Setting(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_features`, `weight`, `score` and `rank` (null: not drawn) of every row of `docs`.

    `target` holds its texts in a column named `text`.
    """
    if key in RESULT:
        raise ValueError(f"an id column named {key} clashes with the result's")
    gain = gains(bucket_counts(docs, setting, text), bucket_counts(target, setting))
    rows = checkpointed(scored(docs, gain, setting, key, text))
    return ranked(rows, setting).select(F.col("_key").alias(key), *RESULT)

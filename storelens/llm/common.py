"""Helpers the operators share: folders, Arrow batches, word hashes."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.checkpoints import checkpointed

__all__ = ["checkpointed"]

# Functions sent to executors carry this package's code with them, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["storelens.llm"])

# Upper-case ASCII to lower case; every ASCII character that is neither a letter nor a digit to a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
# Texts a worker looks at together; bounds what one step holds besides its Arrow batch.
TEXTS_AT_ONCE = 256
# A worker's table of words is started anew beyond this many entries.
TABLE_ENTRIES = 400_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes, so long texts do not meet in one batch; a setting of the session wins."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def batches(frame: DataFrame, schema: str, each: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """mapInArrow over slices of a few hundred rows.

    `each()` runs once a task and returns the function that turns a slice into
    dictionaries of columns, one per output batch.
    """
    small_batches(frame.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(frame.sparkSession.createDataFrame([], schema).schema)

    def run(parts):
        step = each()
        for part in parts:
            for start in range(0, part.num_rows, TEXTS_AT_ONCE):
                for out in step(part.slice(start, TEXTS_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip((out[f.name] for f in fields), fields)],
                        schema=fields,
                    )

    return frame.mapInArrow(run, schema)


def kept_names(keep: list[str], added: list[str]) -> dict[str, str]:
    """The names kept columns get beside added ones: their own, or with `_kept` behind it (again where that is taken too)."""
    taken = {c.lower() for c in [*keep, *added]}
    names = {}
    for column in keep:
        name = column
        if column.lower() in {c.lower() for c in added}:
            while name.lower() in taken:
                name += "_kept"
            taken.add(name.lower())
        names[column] = name
    return names


def lists(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    """A list column from its concatenated values and the sizes of its lists."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


class WordHashes:
    """64-bit hashes of words, kept in a bounded table."""

    def __init__(self):
        self.table: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        table = self.table
        for word in set(words).difference(table):
            table[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (fixed multipliers of a common finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hashes of all runs of `size` hashes."""
    count = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(count, size, np.uint64)
        for i in range(size):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def ascii_words(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits; all characters beyond ASCII count as letters."""
    return text.encode().translate(WORD_TABLE).split()


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def bounded_sample(frame: DataFrame, by: str, rows: int, key: str) -> DataFrame:
    """About `rows` rows of each value of `by` at most, chosen by a hash of `key`.

    One aggregate counts the rows of each value; a value with fewer keeps them all.
    """
    counts = frame.groupBy(by).count().collect()
    shares = [F.when(F.col(by) == r[by], F.lit(min(1.0, rows / r["count"]))) for r in counts]
    share = F.coalesce(*shares, F.lit(0.0)) if shares else F.lit(0.0)
    return frame.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < share * 1_000_000)

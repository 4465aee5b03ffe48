"""Exact duplicates by composable polynomial fingerprints.

A text's bytes, runs of white space made one space, are the digits of a number
in two fixed bases, each modulo a prime. The fingerprint of two texts in a row
follows from theirs and the length of the second, so a huge text is cut into
chunks that are hashed in different tasks and combined. Texts whose fingerprint
and size occur more than once are compared chunk by chunk; a class is what was
found equal byte for byte, so two texts that share a fingerprint by accident or
by intent are told apart.

Texts travel only when their fingerprint may be repeated. Which may is a bitmap
of fixed size; a task sends the first of the texts it found equal and only its
chunks, and the least and the greatest of all chunks in one place are equal
only if all are.

Null texts count as empty. A text of white space only equals one space, not the
empty text. Of rows with the same text the smallest key stays; of repeated rows
with that key one. A row without a key stays only if no row of its class has
one, and then one of them. An empty table gives an empty result. Other columns
of the table are neither read nor in conflict; a key column named like a result
column is an error.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import batches, checkpointed

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_664_525_003)
# Bytes of one product: 255 * 2^31 * 8192 < 2^53, so sums of doubles are exact.
BLOCK = 8192
# Bytes of a chunk, and of a text from which on its chunks are hashed in other tasks.
CHUNK = 1 << 18
HUGE = 8 << 20
# Bits of the map of repeated fingerprints.
MAP_BITS = 26
# Bytes of texts a task holds to compare later ones with.
HELD_BYTES = 64 << 20
# Parts of a class that are joined apart, at most.
PIECES = 1024

SPACES = b" \t\n\x0b\x0c\r"
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _descending_powers(base: int, prime: int) -> np.ndarray:
    powers = [1]
    for _ in range(BLOCK - 1):
        powers.append(powers[-1] * base % prime)
    return np.array(powers[::-1], np.float64)


class Hasher:
    """Fingerprints of byte strings and of their concatenations."""

    def __init__(self):
        self.powers = [_descending_powers(b, p) for b, p in zip(BASES, PRIMES)]

    def of(self, data: bytes) -> tuple[int, int]:
        digits = np.frombuffer(data, np.uint8).astype(np.float64)
        out = (0, 0)
        for start in range(0, len(digits), BLOCK):
            block = digits[start : start + BLOCK]
            own = tuple(int(block @ w[BLOCK - len(block) :]) % p for w, p in zip(self.powers, PRIMES))
            out = own if start == 0 else joined(out, own, len(block))
        return out


def joined(a: tuple[int, int], b: tuple[int, int], size: int) -> tuple[int, int]:
    """Fingerprint of a text and one of `size` bytes after it."""
    return tuple((x * pow(base, size, p) + y) % p for x, y, base, p in zip(a, b, BASES, PRIMES))


def packed(high: int, low: int) -> int:
    return high << 31 | low


def normalised(data: bytes) -> Iterator[bytes]:
    """The text with one space for each run of white space, in chunks of CHUNK bytes (the last may be shorter)."""
    rest, after_space = b"", False
    for start in range(0, len(data), CHUNK):
        part = data[start : start + CHUNK]
        body = b" ".join(part.split())
        lead = part[0] in SPACES and not after_space
        after_space = part[-1] in SPACES
        rest += (b" " if lead else b"") + body + (b" " if after_space and body else b"")
        if len(rest) >= CHUNK:
            yield rest[:CHUNK]
            rest = rest[CHUNK:]
    if rest:
        yield rest


def _named(data: bytes, hasher: Hasher) -> tuple[int, int, list[bytes]]:
    """Packed fingerprint, size and chunks of a text."""
    total, size, chunks = (0, 0), 0, []
    for chunk in normalised(data):
        own = hasher.of(chunk)
        total = joined(total, own, len(chunk)) if size else own
        size += len(chunk)
        chunks.append(chunk)
    return packed(*total), size, chunks


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_data"))


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_key`, `_print`, `_size` and `_digest` (SHA-256 of the normalised text) of every row."""
    texts = _texts(docs, key, text)
    huge = HUGE
    kind = dict(texts.dtypes)["_key"]

    def each():
        hasher, task, rows = Hasher(), TaskContext.get().partitionId() << 33, 0

        def step(part):
            nonlocal rows
            found = []
            for at, data in enumerate(part.column("_data").to_pylist()):
                data, rows = data or b"", rows + 1
                digest = hashlib.sha256()
                if len(data) <= huge:
                    name, size, chunks = _named(data, hasher)
                    for chunk in chunks:
                        digest.update(chunk)
                    found.append((at, name, size, digest.hexdigest(), None))
                    continue
                for number, chunk in enumerate(normalised(data)):
                    digest.update(chunk)
                    yield _columns(part.column("_key").slice(at, 1), [(None, len(chunk), None, task + rows, number, chunk)])
                found.append((at, None, None, digest.hexdigest(), task + rows))
            keys = part.column("_key").take(pa.array([f[0] for f in found], pa.int64()))
            yield _columns(keys, [(name, size, digest, row, None, None) for _, name, size, digest, row in found])

        return step

    names = ("_print", "_size", "_digest", "_row", "_number", "_chunk")

    def _columns(keys, rows):
        return {"_key": keys, **{c: [r[i] for r in rows] for i, c in enumerate(names)}}

    schema = f"_key {kind}, _print long, _size long, _digest string, _row long, _number int, _chunk binary"
    made = checkpointed(batches(texts, schema, each))
    whole = made.where("_row is null").select("_key", "_print", "_size", "_digest")
    heads = made.where("_row is not null and _chunk is null").select("_key", "_row", "_digest")
    combined = _combined(made.where("_chunk is not null").select("_row", "_number", "_size", "_chunk"))
    return whole.unionByName(heads.join(combined, "_row").drop("_row"))


def _combined(chunks: DataFrame) -> DataFrame:
    """`_row`, `_print` and `_size` of texts whose chunks are hashed wherever they land."""

    def each():
        hasher = Hasher()

        def step(part):
            data = part.column("_chunk").to_pylist()
            found = [hasher.of(x) for x in data]
            yield {
                "_row": part.column("_row"), "_number": part.column("_number"), "_size": part.column("_size"),
                **{f"_h{i}": [f[i] for f in found] for i in range(2)},
                **{f"_s{i}": [pow(BASES[i], len(x), PRIMES[i]) for x in data] for i in range(2)},
            }

        return step

    schema = "_row long, _number int, _size long, _h0 long, _h1 long, _s0 long, _s1 long"
    hashed = batches(chunks.repartition("_row", "_number"), schema, each)
    ordered = F.sort_array(F.collect_list(F.struct("_number", "_size", "_h0", "_h1", "_s0", "_s1")))

    def folded(i: int) -> Column:
        return F.aggregate("_all", F.lit(0).cast("long"), lambda h, c: (h * c[f"_s{i}"] + c[f"_h{i}"]) % F.lit(PRIMES[i]))

    return hashed.groupBy("_row").agg(ordered.alias("_all")).select(
        "_row", F.shiftleft(folded(0), 31).bitwiseOR(folded(1)).alias("_print"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda n, c: n + c["_size"]).alias("_size"),
    )


def _bitmap(names: DataFrame) -> bytes:
    """Bits of the low MAP_BITS of `_print`; at most 2^(MAP_BITS - 6) rows reach the driver."""
    at = F.col("_print").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = names.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(_print & 63 as int))")).alias("bits")
    )
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def _chunks_of(docs: DataFrame, names: DataFrame, key: str, text: str, each_row: bool) -> DataFrame:
    """Chunks of texts whose fingerprint the bitmap of `names` holds: of every row, or of the first of the
    texts that a task found equal."""
    texts = _texts(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(names))
    kind = dict(texts.dtypes)["_key"]
    mask, bound = (1 << MAP_BITS) - 1, HELD_BYTES

    def each():
        bits = np.frombuffer(sent.value, np.uint64)
        hasher, task, rows = Hasher(), TaskContext.get().partitionId() << 33, 0
        held: OrderedDict[tuple[int, int], list[bytes]] = OrderedDict()
        bytes_held = 0

        def new(name, size, chunks) -> bool:
            """Whether no equal text of the task is held; holds this one if it may."""
            nonlocal bytes_held
            if (name, size) in held:
                held.move_to_end((name, size))
                return held[name, size] != chunks
            if size <= bound:
                held[name, size] = chunks
                bytes_held += size
                while bytes_held > bound:
                    bytes_held -= held.popitem(last=False)[0][1]
            return True

        def step(part):
            nonlocal rows
            out = []
            for at, data in enumerate(part.column("_data").to_pylist()):
                rows += 1
                name, size, chunks = _named(data or b"", hasher)
                place = name & mask
                if not int(bits[place >> 6]) >> (place & 63) & 1 or not (each_row or new(name, size, chunks)):
                    continue
                digest = hashlib.sha256(b"".join(chunks)).hexdigest() if each_row else None
                out += [(at, name, size, digest, task + rows, i, chunk) for i, chunk in enumerate(chunks or [b""])]
            names = ("_print", "_size", "_digest", "_row", "_number", "_chunk")
            keys = part.column("_key").take(pa.array([o[0] for o in out], pa.int64()))
            yield {"_key": keys, **{c: [o[i + 1] for o in out] for i, c in enumerate(names)}}

        return step

    return batches(texts, f"_key {kind}, _print long, _size long, _digest string, _row long, _number int, _chunk binary", each)


def _told_apart(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of the fingerprints `names`, which different texts share, with `_class`: the least row that has
    the same bytes, for each chunk."""
    chunks = checkpointed(_chunks_of(docs, names, key, text, True).join(names, ["_print", "_size"], "left_semi"))
    place = ["_print", "_size", "_number", "_chunk"]
    least = chunks.groupBy(place).agg(F.min("_row").alias("_least"))
    found = chunks.join(least, place).groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ("_key", "_print", "_size", "_digest")],
        F.sort_array(F.collect_list(F.struct("_number", "_least"))).alias("_places"),
    )
    return found.select("_key", "_print", "_size", "_digest", F.col("_places._least").alias("_class"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of every row, `keep_id` (the key that stays), `group_size`, `kept` and `text_sha256`."""
    if key in RESULT:
        raise ValueError(f"a key column named {key} clashes with the result's")
    named = prints(docs, key, text)
    name = ["_print", "_size"]
    repeated = checkpointed(named.groupBy(name).count().where("count > 1").select(name))
    seen = _chunks_of(docs, repeated, key, text, False)
    ends = seen.groupBy(*name, "_number").agg(F.min("_chunk").alias("a"), F.max("_chunk").alias("b"))
    shared = checkpointed(ends.where("a <> b").select(name).distinct())

    rows = named.withColumn("_class", F.array().cast("array<long>"))
    if not shared.isEmpty():
        rows = rows.join(shared, name, "left_anti").unionByName(_told_apart(docs, shared, key, text))
    of = [*name, "_class"]
    # Rows that share key and text are one row with a number of copies until the end.
    once = rows.groupBy(*of, "_key").agg(F.count(F.lit(1)).alias("_copies"), F.first("_digest").alias("text_sha256"))
    # A class meets its facts in as many pieces as its keys fall into, so copies of one text fill many tasks.
    dealt = once.withColumn("_piece", F.pmod(F.xxhash64("_key"), F.lit(PIECES)))
    parts = dealt.groupBy(*of, "_piece").agg(F.min("_key").alias("_least"), F.sum("_copies").alias("_n"))
    groups = parts.groupBy(of).agg(
        F.min("_least").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_list("_piece").alias("_pieces")
    ).withColumn("_piece", F.explode("_pieces")).drop("_pieces")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")
    return dealt.join(groups, [*of, "_piece"]).select("*", copy).select(
        F.col("_key").alias(key), "keep_id", "group_size",
        (F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256",
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    stays = duplicates(docs, key, text).where("kept").select(F.col(key).alias("_key"), F.col("text_sha256").alias("_digest"))
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    own = next(n for n in map("_own{}".format, count()) if n not in docs.columns)
    named = docs.withColumn(own, F.sha2(plain, 256))
    same = named[own].eqNullSafe(stays["_digest"]) & named[key].eqNullSafe(stays["_key"])
    return named.join(stays, same, "left_semi").dropDuplicates([key, own]).drop(own)

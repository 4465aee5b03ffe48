"""Operator 6: piece encoding and decoding with a table of distinct chunks.

The vocabulary has no piece in which a white-space marker follows another
character, so the text can be cut before every run of markers and each cut-out
chunk segmented alone. A task segments each distinct chunk once, keeps the
result in a bounded table, and joins ids and decoded texts back by position.

Null and empty texts have no ids and decode to the empty text. Repeated rows
are encoded alike; columns besides the text stay as they are.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import batches, lists

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
# Longer chunks are rarely met again; they are segmented each time.
KEPT_CHARS = 64
# Distinct chunks a task holds; beyond, the older half goes.
TABLE_CHUNKS = 200_000
# A model file is sent to the executors with each task; larger ones are refused.
MODEL_BYTES = 64 << 20


def model_bytes(path: str) -> bytes:
    """The model file's bytes, after checking its size and that chunks can be encoded apart."""
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = map(processor.id_to_piece, range(processor.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
        raise ValueError("a piece crosses a white-space marker; chunks cannot be encoded apart")
    for probe in ("a  b", " a ", "ﬁ x"):
        if processor.decode(processor.encode(probe)) != probe:
            raise ValueError("the model changes white space or characters; chunks cannot be encoded apart")
    return model


class ChunkTable:
    """Ids of each distinct chunk, as bytes, and its decoded text where that is not the chunk itself.

    A chunk is named by what follows its first marker.
    """

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.get_piece_size()
        plain = (not (self.processor.is_byte(i) or self.processor.is_unknown(i) or self.processor.is_control(i)) for i in range(size))
        # Pieces that decode to themselves; others go through the library's decoder.
        self.pieces = [self.processor.id_to_piece(i) if p else "\n" for i, p in enumerate(plain)]
        self.alone = [self.processor.piece_to_id(MARK)]
        self.ids: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}

    def chunks(self, text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        if not marked:
            return []
        if MARK * 2 not in marked and marked[0] != MARK and marked[-1] != MARK:
            return marked.split(MARK)
        return [chunk[1:] for chunk in CHUNK.findall(MARK + marked)]

    def learn(self, new: list[str]) -> None:
        """Segments chunks that are not in the table."""
        names, pieces, ids, changed = {MARK + x: x for x in new}, self.pieces, self.ids, self.changed
        encoded = self.processor.encode([x.replace(MARK, " ") for x in new], num_threads=1)
        for (chunk, name), numbers in zip(names.items(), encoded):
            if not name:
                numbers = self.alone
            ids[name] = array("i", numbers).tobytes()
            if "".join([pieces[i] for i in numbers]) != chunk:
                changed[name] = self.processor.decode(numbers) if name else ""

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (as bytes of 32-bit numbers) and decoded texts."""
        split = [self.chunks(x) for x in texts]
        there = set().union(*split)
        new = sorted(there.difference(self.ids))
        if len(self.ids) + len(new) > TABLE_CHUNKS:
            for name in list(islice(self.ids, len(self.ids) // 2)):
                del self.ids[name]
                self.changed.pop(name, None)
            new = sorted(there.difference(self.ids))
        self.learn(new)
        ids = [b"".join(map(self.ids.__getitem__, x)) for x in split]
        odd = self.changed.keys() & there
        decoded = [
            "".join([" " + (self.changed[c] if c in odd else c) for c in x])[1:] if odd and not odd.isdisjoint(x) else " ".join(x)
            for x in split
        ]
        for name in new:
            if len(name) > KEPT_CHARS:
                del self.ids[name]
                self.changed.pop(name, None)
        return ids, [x.replace(MARK, " ") for x in decoded]


def encode(docs: DataFrame, model: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, `ids` (array of int) and `decoded`, for every row of `docs`."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "decoded string"])

    def each():
        table = ChunkTable(sent.value)

        def step(part):
            ids, decoded = table.encode([x or "" for x in part.column("_text").to_pylist()])
            yield {
                **{c: part.column(c) for c in keep},
                "ids": lists(np.frombuffer(b"".join(ids), np.int32), [len(x) // 4 for x in ids], pa.int32()),
                "decoded": decoded,
            }

        return step

    return batches(docs.select(*keep, F.col(text).alias("_text")), schema, each)


def decode(frame: DataFrame, model: bytes, keep: list[str], ids: str = "ids") -> DataFrame:
    """`keep` columns and `decoded`, the library's text of the ids; null ids decode to the empty text."""
    sent = frame.sparkSession.sparkContext.broadcast(model)
    kinds = dict(frame.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded string"])

    def each():
        processor = sentencepiece.SentencePieceProcessor(model_proto=sent.value)

        def step(part):
            yield {
                **{c: part.column(c) for c in keep},
                "decoded": [processor.decode(x or []) for x in part.column("_ids").to_pylist()],
            }

        return step

    return batches(frame.select(*keep, F.col(ids).alias("_ids")), schema, each)


def digests(encoded: DataFrame) -> DataFrame:
    """Replaces ids and decoded text by their number and SHA-256 digests."""
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("ids", "decoded")

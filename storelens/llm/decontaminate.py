"""Operator 5: benchmark decontamination.

The benchmark's windows of ten normalised words (an item of fewer words is one
window) form a hash set that is broadcast when its measured size allows. A task
gives each document word its number in the benchmark's vocabulary, rolls a hash
over the numbers, looks the hashes up and verifies every hit by its words.
Beyond the bound, document and benchmark windows meet in a shuffled join.

Null and empty texts have no words and no hits. An item without words has no
window. Repeated rows are judged alike; a repeated item id counts once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import ascii_words, batches, checkpointed, gram_hashes

WINDOW = 10
# The benchmark's texts are gathered and broadcast up to this many bytes.
BENCHMARK_BYTES = 4 << 20
# Rolling hashes are first looked up in a bit map of 2 ** MAP_BITS entries.
MAP_BITS = 22
FOUND = "`{}` long, `{}` array<struct<start: int, end: int>>, `{}` array<string>"
# The words of an original text, in the same places as those of ascii_words().
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_windows(text: str | None, size: int) -> list[tuple[bytes, ...]]:
    words = ascii_words(text or "")
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WindowSet:
    """Windows of the benchmark by their words."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        found = defaultdict(set)
        for item, text in items:
            for window in item_windows(text, size):
                found[b" ".join(window)].add(item)
        self.items = {window: sorted(ids) for window, ids in found.items()}
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in found for w in x.split(b" ")}), 1)}
        self.lengths = sorted({x.count(b" ") + 1 for x in found})

    def maps(self) -> list[tuple[int, np.ndarray]]:
        """For each length, a bit map of the windows' rolling hashes."""
        made = []
        for length in self.lengths:
            own = [x.split(b" ") for x in self.items if x.count(b" ") + 1 == length]
            numbers = np.array([[self.vocabulary[w] for w in x] for x in own], np.uint64)
            there = np.zeros(1 << MAP_BITS, bool)
            there[np.concatenate([gram_hashes(x, length) for x in numbers]) >> np.uint64(64 - MAP_BITS)] = True
            made.append((length, there))
        return made


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ordered half-open spans, touching and overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def small_enough(benchmark: DataFrame, max_bytes: int) -> bool:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    return benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= max_bytes


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    size: int = WINDOW,
    max_bytes: int = BENCHMARK_BYTES,
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """`keep` columns, `n_words`, `spans` (word ranges hit, array of start and end) and `items` (their ids as
    sorted strings; all three under other `names` if given), for every row of `docs`."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    if small_enough(items, max_bytes):
        return _hits_by_broadcast(docs, items, keep, text, size, names)
    return _hits_by_join(docs, items, keep, text, size, names)


def _schema(docs: DataFrame, keep: list[str], more: str) -> str:
    kinds = dict(docs.select(*keep).dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), more])


def _hits_by_broadcast(docs, items, keep, text, size, names) -> DataFrame:
    rows = [(r["item"], r["text"]) for r in items.where("item is not null").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    schema = _schema(docs, keep, FOUND.format(*names))

    def each():
        windows = WindowSet(sent.value, size)
        number, maps = windows.vocabulary.get, windows.maps()

        def step(part):
            texts = [ascii_words(x or "") for x in part.column("_text").to_pylist()]
            sizes = np.array([len(x) for x in texts])
            # A 0 after each text keeps windows from running into the next one.
            words = list(chain.from_iterable(chain(x, (b"",)) for x in texts))
            numbers = np.fromiter((number(w, 0) for w in words), np.uint64, len(words))
            starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            spans, found = [[] for _ in texts], [set() for _ in texts]
            for length, there in maps:
                if len(numbers) < length:
                    continue
                hashes = gram_hashes(numbers, length)
                for at in np.flatnonzero(there[hashes >> np.uint64(64 - MAP_BITS)]).tolist():
                    if ids := windows.items.get(b" ".join(words[at : at + length])):
                        k = int(np.searchsorted(starts, at, "right")) - 1
                        spans[k].append((at - int(starts[k]), at - int(starts[k]) + length))
                        found[k].update(ids)
            yield {
                **{c: part.column(c) for c in keep},
                names[0]: sizes,
                names[1]: [[{"start": a, "end": b} for a, b in merged(x)] for x in spans],
                names[2]: [sorted(x) for x in found],
            }

        return step

    return batches(docs.select(*keep, F.col(text).alias("_text")), schema, each)


def _hits_by_join(docs, items, keep, text, size, names) -> DataFrame:
    """The same from a shuffled join of windows, for a benchmark of any size.

    Windows are named by two independent 64-bit hashes of their words. Window
    lengths are at most `size`, so a document gives at most `size` rows a word.
    """

    def digest(words):
        whole = xxhash.xxh3_128_intdigest(b" ".join(words))
        return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)

    def of_items():
        def step(part):
            rows = [
                (len(w), *digest(w), item)
                for item, x in zip(part.column("item").to_pylist(), part.column("text").to_pylist())
                for w in item_windows(x, size)
            ]
            yield {c: [r[i] for r in rows] for i, c in enumerate(("length", "high", "low", "item"))}

        return step

    windows = checkpointed(
        batches(items.where("item is not null"), "length int, high long, low long, item string", of_items).distinct()
    )
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `size` numbers

    def of_docs():
        def step(part):
            rows = []
            for key, x in zip(part.column("_key").to_pylist(), part.column("_text").to_pylist()):
                words = ascii_words(x or "")
                rows += [
                    (key, i, n, *digest(words[i : i + n])) for n in lengths for i in range(len(words) - n + 1)
                ]
            yield {c: [r[i] for r in rows] for i, c in enumerate(("_key", "at", "length", "high", "low"))}

        return step

    # Rows with the same text have the same hits, so a text is looked up once.
    keyed = docs.select(*keep, F.col(text).alias("_text")).withColumn("_key", F.sha2(F.coalesce("_text", F.lit("")), 256))
    once = keyed.groupBy("_key").agg(F.first("_text").alias("_text"))
    places = batches(once, "_key string, at int, length int, high long, low long", of_docs)
    # A window shared by many items meets each of its places once: its items come later, by window.
    once_each = windows.select("length", "high", "low").distinct()
    hits = checkpointed(places.join(once_each, ["length", "high", "low"], "left_semi"))
    covered = hits.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias("_places"))
    named = (
        hits.select("_key", "length", "high", "low").distinct().join(windows, ["length", "high", "low"])
        .groupBy("_key").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    )

    def finish():
        def step(part):
            places, found = part.column("_places").to_pylist(), part.column("_items").to_pylist()
            spans = [merged([(p["at"], p["at"] + p["length"]) for p in x or []]) for x in places]
            yield {
                **{c: part.column(c) for c in keep},
                names[0]: [len(ascii_words(x or "")) for x in part.column("_text").to_pylist()],
                names[1]: [[{"start": a, "end": b} for a, b in x] for x in spans],
                names[2]: [x or [] for x in found],
            }

        return step

    schema = _schema(docs, keep, FOUND.format(*names))
    return batches(keyed.join(covered.join(named, "_key"), "_key", "left").drop("_key"), schema, finish)


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", size: int = WINDOW) -> DataFrame:
    """`docs` without contaminated documents, or (`remove="spans"`) with the hit words cut from their texts."""
    columns = docs.columns
    names = ("_n_words", "_spans", "_items")
    found = find_hits(docs, benchmark, columns, text, size, names=names)
    if remove == "documents":
        return found.where(F.size("_spans") == 0).select(*columns)

    def each():
        def step(part):
            spans = [[(s["start"], s["end"]) for s in x] for x in part.column("_spans").to_pylist()]
            texts = [without_spans(x, s) for x, s in zip(part.column(text).to_pylist(), spans)]
            yield {**{c: part.column(c) for c in columns}, text: texts}

        return step

    cut = batches(found, _schema(docs, columns, "")[:-2], each)
    return cut.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in columns else cut


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of find_hits()."""
    return found.select(
        *[c for c in found.columns if c not in ("spans", "items")],
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )

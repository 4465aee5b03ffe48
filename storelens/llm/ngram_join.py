"""Operator 1: exact Jaccard join of word n-gram sets, with set-relation skipping.

Sets are read twice: once to count shingle hashes in a table of fixed size, once
to order each set from rare to common and keep its prefix. Then

1. Equal sets share their answers: one class stands for all of them.
2. Answers of highly similar sets: classes with an equal minimum hash and like
   size are compared with one leader of their bucket, not with each other. A
   class linked with its leader takes over the leader's component.
3. Block-skipping index lists: a prefix entry at place i of a set of size n can
   only reach partners up to a size that falls with i. Lists are cut into blocks
   by partner size; an entry is listed only in the blocks it reaches, and a
   probe reads the one block of its own size. Pairs whose components are known
   to be equal are skipped, as are pairs whose parity bitmaps differ in more
   places than linked sets of their sizes can (a differing shingle flips one bit).
4. Derived answers: a remaining pair's overlap is bounded from its leaders'
   overlap and both differences. Only pairs that the bounds leave open, and
   leaders, are verified on their whole sets.

Steps 2 and 4 only save work; step 3 meets every pair that can link, so the
result is exact (up to 64-bit hashes of shingles and 128-bit hashes of sets).

A document without a word has an empty set and is linked with nothing; one with
fewer words than a shingle has its whole sequence as one shingle. Rows that
repeat a doc_id are rows of their own; equal sets always link. Rows without an id
link like others; they take the smallest id of their component, null if it has none.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import WordHashes, batches, checkpointed, gram_hashes, lists, mixed
from storelens.llm.components import connected_components

# The count table: 2 ** COUNT_BITS counters in CHUNKS rows. It steers the order of shingles, never the result.
COUNT_BITS = 18
CHUNKS = 16
# Slots of document ids, marked where a text is needed again.
SLOT_BITS = 24
# Bits of a set's parity bitmap.
PARITY_BITS = 1024
# Minimum hashes a set; each gives its class a bucket with one leader.
LEADERS = 4


@dataclass(frozen=True)
class Rule:
    """Two sets link when den * intersection >= num * union; shingles have `words` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, a: Column, b: Column) -> Column:
        """The least intersection of linked sets of these sizes."""
        return F.ceil((a + b) * self.num / F.lit(float(self.num + self.den)) - F.lit(1e-9)).cast("long")

    def linked(self, both: Column, a: Column, b: Column) -> Column:
        return both * (self.num + self.den) >= (a + b) * self.num

    def probe_length(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def index_length(self, n: Column) -> Column:
        return n - F.ceil(n * 2 * self.num / F.lit(float(self.num + self.den)) - F.lit(1e-9)).cast("long") + 1

    def reach(self, rest: Column, n: Column) -> Column:
        """The largest partner of a set of size n whose first common shingle leaves `rest` of the set."""
        return F.floor(rest * (self.num + self.den) / F.lit(float(self.num)) + F.lit(1e-9)).cast("long") - n

    def block(self, n: Column) -> Column:
        """Blocks of sizes; linked sets lie in the same or in adjacent ones."""
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(self.den / self.num))).cast("int")


def shingles(text: str | None, words: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the text's words (A-Z lower-cased, cut at ASCII white space)."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(table.of(split), min(words, len(split))))


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of shingles falls on it; as 64-bit numbers."""
    odd = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes byte by byte, all first bytes first, which a shuffle can compress."""
    return hashes.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0]


def set_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def shingle_counts(docs: DataFrame, rule: Rule, text: str = "text") -> np.ndarray:
    """How many sets hold a shingle, by the top bits of its hash. Tables are added up as they stream by."""
    width = (1 << COUNT_BITS) // CHUNKS

    def tally(parts):
        table, total = WordHashes(), np.zeros(1 << COUNT_BITS, np.int64)
        for part in parts:
            found = [shingles(x, rule.words, table) for x in part.column("_text").to_pylist()]
            found = np.concatenate([np.zeros(0, np.uint64), *found]) >> np.uint64(64 - COUNT_BITS)
            total += np.bincount(found.astype(np.int64), minlength=len(total))
        if total.any():
            rows = total.reshape(CHUNKS, width)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": [x.tobytes() for x in rows]})

    def add(parts):
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for chunk, x in zip(part.column("chunk").to_pylist(), part.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(x, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": [x.tobytes() for x in sums.values()]})

    schema = "chunk int, counts binary"
    found = docs.select(F.col(text).alias("_text")).mapInArrow(tally, schema)
    # First in as many tasks as the session's shuffles have, then one task a chunk.
    found = found.repartition("chunk", F.spark_partition_id()).mapInArrow(add, schema)
    found = found.repartition(CHUNKS, "chunk").mapInArrow(add, schema)
    total = np.zeros((CHUNKS, width), np.int64)
    for row in found.collect():  # 2 ** COUNT_BITS numbers, whatever the corpus
        total[row["chunk"]] += np.frombuffer(row["counts"], np.int64)
    return total.reshape(-1)


def described(docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """For every document the size and name of its set, its minimum hashes and its prefix, rare shingles first."""
    sent = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, rule, text).astype(np.float32))
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, digest long, n long, name binary, least array<long>, bits array<long>, prefix array<long>"

    def each():
        table, counts = WordHashes(), sent.value
        seeds = np.arange(1, LEADERS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)

        def step(part):
            sizes, names, least, bits, prefixes = [], [], [], [], []
            for x in part.column("_text").to_pylist():
                found = shingles(x, rule.words, table)
                n = len(found)
                sizes.append(n)
                names.append(set_name(found) if n else None)
                least.append([int(mixed(found ^ s).min().view(np.int64)) for s in seeds] if n else [])
                bits.append(parity(found))
                # Equal counts keep the order of the hashes, so all sets use one order.
                order = np.argsort(counts[found >> np.uint64(64 - COUNT_BITS)], kind="stable")
                prefixes.append(found[order[: rule.probe_length(n)]].view(np.int64) if n else np.zeros(0, np.int64))
            yield {
                key: part.column(key),
                "digest": part.column("_digest"),
                "n": sizes,
                "name": names,
                "least": least,
                "bits": lists(np.concatenate(bits), [len(x) for x in bits], pa.int64()),
                "prefix": lists(np.concatenate(prefixes), [len(x) for x in prefixes], pa.int64()),
            }

        return step

    return batches(docs.select(key, F.xxhash64(text).alias("_digest"), F.col(text).alias("_text")), schema, each)


def overlaps(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """`pairs` (a, b: names of classes) with the size `both` of their intersection, from whole sets.

    Only the texts of classes in some pair are read again. A text is recognised
    by its set's name, so a repeated document id cannot bring in another text.
    """
    pairs = checkpointed(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SLOT_BITS))
    word, bit = lambda c: F.shiftright(slot(c), 6), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (slot(c) % 64).cast("int"))
    # A bit per slot of document ids, in at most 2 ** (SLOT_BITS - 6) rows: lets few needless texts through.
    marks = classes.join(needed, "name").select(word("first").alias("word"), bit("first").alias("bit"))
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    texts = docs.select(word(key).alias("word"), bit(key).alias("bit"), F.col(text).alias("_text"))
    texts = texts.join(F.broadcast(marks), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("_text")

    def whole():
        table = WordHashes()

        def step(part):
            found = [shingles(x, rule.words, table) for x in part.column("_text").to_pylist()]
            found = [x for x in found if len(x)]
            yield {"name": [set_name(x) for x in found], "hashes": [planes(x) for x in found]}

        return step

    # A set that comes twice, from a repeated row, gives its pairs twice, which are made one at the end.
    sets = checkpointed(batches(texts, "name binary, hashes binary", whole))

    def compare():
        def step(part):
            both = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
                x, y = from_planes(x), from_planes(y)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both.append(int((y[at] == x).sum()))
            yield {"a": part.column("a"), "b": part.column("b"), "both": both}

        return step

    left = pairs.join(sets.select(F.col("name").alias("a"), F.col("hashes").alias("x")), "a")
    full = left.join(sets.select(F.col("name").alias("b"), F.col("hashes").alias("y")), "b")
    return batches(full.select("a", "b", "x", "y"), "a binary, b binary, both long", compare).distinct()


def _sizes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    size = classes.select("name", "n")
    return pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")


def _reachable(rule: Rule) -> Column:
    """Whether sets of sizes n_a, n_b and parity bitmaps x, y can link: they differ in at least as many shingles as
    their bitmaps in bits, which bounds the overlap."""
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    return F.col("n_a") + F.col("n_b") - apart >= 2 * rule.overlap(F.col("n_a"), F.col("n_b"))


def leader_pairs(classes: DataFrame, rule: Rule) -> DataFrame:
    """Each class with the leader (most copies, then smallest name) of its minimum-hash buckets."""
    buckets = classes.select("name", "n", "copies", F.posexplode("least").alias("place", "least"))
    buckets = buckets.withColumn("block", rule.block(F.col("n")))
    keys = ["place", "least", "block"]
    best = buckets.groupBy(*keys).agg(
        F.max(F.struct("copies", "name", "n")).alias("leader"), F.count(F.lit(1)).alias("size")
    )
    pairs = buckets.join(best.where("size > 1"), keys).where("name != leader.name")
    like = F.least("n", "leader.n") * rule.den >= F.greatest("n", "leader.n") * rule.num
    pairs = pairs.where(like).select(F.col("name").alias("a"), F.col("leader.name").alias("b")).distinct()
    own = classes.select("name", "n", "bits")
    pairs = pairs.join(own.toDF("a", "n_a", "x"), "a").join(own.toDF("b", "n_b", "y"), "b")
    return pairs.where(_reachable(rule)).select("a", "b")


def block_pairs(grouped: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs across components. `grouped` has id and n of a class, its prefix and group (a number of its component)."""
    entries = grouped.select("n", "group", "id", F.posexplode("prefix").alias("place", "entry"))
    # Only entries that lie in several components can bring a pair. Found by partial minima, so a common entry is one row a task.
    ends = entries.groupBy("entry").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g < h").select("entry")
    entries = checkpointed(entries.join(checkpointed(ends), "entry", "left_semi")).withColumn("rest", F.col("n") - F.col("place"))
    reach = rule.reach(F.col("rest"), F.col("n"))
    blocks = F.sequence(rule.block(F.col("n")), rule.block(F.greatest(F.col("n"), reach)))
    listed = entries.where(F.col("place") < rule.index_length(F.col("n"))).where(reach >= F.col("n"))
    listed = listed.select(
        "entry", F.explode(blocks).alias("block"), F.col("n").alias("n_l"), F.col("id").alias("id_l"),
        F.col("group").alias("group_l"), reach.alias("reach_l"),
    )
    probes = entries.select("entry", rule.block(F.col("n")).alias("block"), "n", "id", "group", reach.alias("reach"))
    smaller = (F.col("n_l") < F.col("n")) | ((F.col("n_l") == F.col("n")) & (F.col("id_l") < F.col("id")))
    met = probes.join(listed, ["entry", "block"]).where(
        smaller & (F.col("group") != F.col("group_l")) & (F.col("reach_l") >= F.col("n")) & (F.col("reach") >= F.col("n_l"))
        & (F.col("n_l") * rule.den >= F.col("n") * rule.num)
    )
    found = met.select("id", "id_l").distinct()
    # Names again; classes whose numbers happen to be equal are all tried, and verified like any.
    names = classes.select(F.xxhash64("name").alias("id"), "name", "n", "bits")
    found = found.join(names.toDF("id", "a", "n_a", "x"), "id").join(names.toDF("id_l", "b", "n_b", "y"), "id_l")
    return found.where("a != b").where(_reachable(rule)).select("a", "b")


def derived(pairs: DataFrame, classes: DataFrame, follow: DataFrame, docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """Linked pairs among candidates, bounded from their leaders' overlap and verified where that leaves them open."""
    own = classes.select("name", "n").join(follow, "name", "left")
    own = own.select("name", "n", F.coalesce("leader", "name").alias("leader"), F.coalesce("both", "n").alias("kept"), F.coalesce("n_leader", "n").alias("n_leader"))
    side = lambda s: own.select(*[F.col(c).alias(f"{c}_{s}") for c in own.columns])
    known = checkpointed(pairs.join(side("a"), F.col("a") == F.col("name_a")).join(side("b"), F.col("b") == F.col("name_b")))
    leaders = known.select(F.least("leader_a", "leader_b").alias("a"), F.greatest("leader_a", "leader_b").alias("b"))
    shared = overlaps(leaders.where("a != b").distinct(), classes, docs, rule, key, text)
    shared = shared.select(F.col("a").alias("least"), F.col("b").alias("most"), "both")
    known = known.withColumn("least", F.least("leader_a", "leader_b")).withColumn("most", F.greatest("leader_a", "leader_b"))
    known = known.join(shared, ["least", "most"], "left").withColumn("both", F.when(F.col("least") == F.col("most"), F.col("n_leader_a")).otherwise(F.col("both")))
    # What a set has beyond its leader may add to the overlap; what its leader has beyond it may be missing.
    most = F.col("both") + (F.col("n_a") - F.col("kept_a")) + (F.col("n_b") - F.col("kept_b"))
    least = F.col("both") - (F.col("n_leader_a") - F.col("kept_a")) - (F.col("n_leader_b") - F.col("kept_b"))
    needed = rule.overlap(F.col("n_a"), F.col("n_b"))
    verdict = F.when(least >= needed, True).when(most < needed, False)
    known = checkpointed(known.select("a", "b", "n_a", "n_b", verdict.alias("verdict")))
    verified = overlaps(known.where("verdict is null").select("a", "b"), classes, docs, rule, key, text)
    verified = verified.join(known.drop("verdict"), ["a", "b"]).where(rule.linked(F.col("both"), F.col("n_a"), F.col("n_b")))
    return known.where("verdict").select("a", "b").union(verified.select("a", "b"))


def _answers(docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """`_id`, `digest` of the text, `n`, `component` and `heads` (whether the row's set stands for its group)."""
    docs = docs.select(F.col(key).alias("_id"), F.col(text).alias("_words"))
    key, text = "_id", "_words"
    rows = checkpointed(described(docs, rule, key, text))
    classes = checkpointed(
        rows.where("n > 0").groupBy("name").agg(
            F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
            F.first("least").alias("least"), F.first("bits").alias("bits"),
        )
    )
    stars = overlaps(leader_pairs(classes, rule), classes, docs, rule, key, text)
    stars = _sizes(stars, classes).where(rule.linked(F.col("both"), F.col("n_a"), F.col("n_b")))
    stars = checkpointed(stars)
    near = checkpointed(connected_components(stars))
    # One row of each class brings its prefix. Copies of that row add nothing: a list never pairs equal ids.
    grouped = classes.join(near.withColumnRenamed("node", "name"), "name", "left")
    grouped = grouped.select("name", F.col("first").alias("_first"), F.xxhash64(F.coalesce("component", "name")).alias("group"))
    led = rows.select("name", key, "n", "prefix").join(grouped, "name").where(F.col(key).eqNullSafe(F.col("_first")))
    grouped = checkpointed(led.select("n", F.xxhash64("name").alias("id"), "group", "prefix"))
    found = checkpointed(block_pairs(grouped, classes, rule))
    follow = stars.groupBy(F.col("a").alias("name")).agg(F.max(F.struct("both", "b", "n_b")).alias("s"))
    follow = follow.select("name", F.col("s.b").alias("leader"), F.col("s.both").alias("both"), F.col("s.n_b").alias("n_leader"))
    links = derived(found, classes, follow, docs, rule, key, text)
    # Links between components of the first step, as edges between those components.
    inner = near.select("node", "component")
    ends = links.join(inner.toDF("a", "c_a"), "a", "left").join(inner.toDF("b", "c_b"), "b", "left")
    outer = connected_components(ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    near = classes.select("name", "first").join(inner.toDF("name", "c"), "name", "left")
    near = near.withColumn("c", F.coalesce("c", "name")).join(outer.toDF("c", "root"), "c", "left")
    near = near.select("name", "first", F.coalesce("root", "c").alias("root"))
    # Of sets with the smallest id, as a repeated id can bring several, the one with the smallest name heads the group.
    head = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "name"))).alias("head")
    heads = near.groupBy("root").agg(head)
    answer = near.join(heads, "root").select("name", F.col("head.first").alias("component"), (F.col("name") == F.col("head.name")).alias("heads"))
    return rows.select(key, "digest", "n", "name").join(answer, "name", "left").select(
        key, "digest", "n", F.coalesce("component", key).alias("component"), F.coalesce("heads", F.col("n") == 0).alias("heads")
    )


def similar_groups(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_shingles` and `component_id` (the smallest key reachable by links) for every row of `docs`."""
    return _answers(docs, rule, key, text).select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of `docs` that are the smallest of their group; of rows that repeat an id and text one stays.

    Two texts under one id are told apart, so of a group one row stays in any
    case. Documents without a word are linked with nothing and stay, as do rows
    without an id.
    """
    stays = _answers(docs, rule, key, text).where(F.col("heads") & (F.col("component") == F.col("_id"))).select("_id", "digest").distinct()
    own = next(n for n in map("_digest{}".format, count()) if n not in docs.columns)
    named = docs.withColumn(own, F.xxhash64(text))
    kept = named.join(stays, (named[key] == stays["_id"]) & (named[own] == stays["digest"]), "left_semi")
    return kept.dropDuplicates([key, own]).drop(own).unionByName(docs.where(F.col(key).isNull()))

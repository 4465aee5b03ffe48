"""Importance resampling, centroid clustering and exact copies against plain Python versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import centroids, exact, importance

# --- importance resampling


def plain_resample(docs, target, setting):
    def features(text):
        found = brute.words(text)
        return [" ".join(found[i : i + n]) for n in range(1, setting.longest + 1) for i in range(len(found) - n + 1)]

    def bucket(feature):
        return zlib.crc32(feature.encode()) % setting.buckets

    source = Counter(bucket(f) for _, t in docs for f in features(t))
    aim = Counter(bucket(f) for t in target for f in features(t))
    all_source, all_aim = sum(source.values()) + setting.buckets, sum(aim.values()) + setting.buckets
    rows = []
    for key, text in docs:
        own = [math.floor(1000 * math.log(((aim[b] + 1) * all_source) / ((source[b] + 1) * all_aim))) for b in map(bucket, features(text))]
        weight = sum(own) // len(own) if own else 0
        name = f"{setting.seed}:{'' if key is None else key}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(own), weight, score, len(brute.words(text)) >= setting.least_words))
    ordered = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    quota = len(ordered) * setting.percent // 100
    return Counter((*r[:4], i + 1 if i < quota else None) for i, r in enumerate(ordered)) + Counter((*r[:4], None) for r in rows if not r[4])


def talk(rng, size):
    return " ".join(rng.choice(["alpha", "Beta", "gamma's", "delta-9", "été", "漢字", "x1"]) + str(rng.randrange(5)) for _ in range(size))


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_plain(spark, longest):
    rng = random.Random(longest)
    docs = [(i, talk(rng, rng.randrange(40))) for i in range(150)]
    docs += [(7, docs[7][1]), (7, "other words " * 15), (None, "no id " * 15), (None, "no id " * 15), (900, None), (901, ""), (902, " \n"), (903, "word " * 50_000)]
    target = [talk(rng, 30), None, "", "unseen"]
    setting = importance.Setting(longest=longest, buckets=50, seed="s", least_words=10, percent=30)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("extra")).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(frame, goal, setting)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == plain_resample(docs, target, setting)


@pytest.mark.parametrize("samples", [1, 7, 10_000])
def test_ranks_over_many_segments_and_ties(spark, monkeypatch, samples):
    monkeypatch.setattr(importance, "SAMPLES", samples)
    rng = random.Random(5)
    # A third of all rows have one score.
    rows = [(i, 30 if i % 9 else 3, 30, 5, 100 if i % 3 == 0 else rng.randrange(200)) for i in range(900)]
    schema = "_key long, n_words long, n_features long, weight long, score long"
    frame = importance.checkpointed(spark.createDataFrame(rows, schema).repartition(6))
    ordered = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    for percent in (0, 10, 100):
        setting = importance.Setting(percent=percent)
        quota = len(ordered) * percent // 100
        wanted = {r[0]: i + 1 if i < quota else None for i, r in enumerate(ordered)}
        found = {r["_key"]: r["rank"] for r in importance.ranked(frame, setting, segment_rows=40).collect()}
        assert found == {r[0]: wanted.get(r[0]) for r in rows}


def test_resampling_of_text_ids_and_empty_tables(spark):
    setting = importance.Setting(buckets=10, least_words=1, percent=50)
    goal = spark.createDataFrame([("a b",)], "text string")
    frame = spark.createDataFrame([("x", "a a"), ("y", "b c"), (None, "d")], "doc_id string, text string")
    found = importance.resample(frame, goal, setting).collect()
    assert sorted((r["rank"] or 0) for r in found) == [0, 0, 1]
    assert importance.resample(frame.limit(0), goal, setting).collect() == []
    assert len(importance.resample(frame, goal.limit(0), setting).collect()) == 3
    with pytest.raises(ValueError):
        importance.resample(frame.withColumnRenamed("doc_id", "rank"), goal, setting, key="rank")


# --- centroid clustering


def plain_clusters(rows, setting):
    kept = [(k, [math.floor(setting.scale * float(x)) for x in v]) for k, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"{setting.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r), r[0] or 0, r[1]))[: setting.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(setting.rounds):
        near = [nearest(v)[1] for _, v in kept]
        for i in range(len(centres)):
            own = [v for (_, v), c in zip(kept, near) if c == i]
            if own:
                centres[i] = [sum(x) // len(own) for x in zip(*own)]
    found = [(k, *nearest(v)) for k, v in kept]
    sums = Counter()
    for _, d, c in found:
        sums[c] += d
    return Counter(
        (k, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for k, d, c in found
    )


def test_planes_give_exact_dot_products():
    rng = np.random.default_rng(3)
    for largest in (1, 5, 1000, 1 << 25):
        values = rng.integers(-largest, largest, (50, 64), endpoint=True)
        values[0], values[1] = largest, -largest
        count = int(np.abs(values).max()).bit_length() + 1
        words, weights = centroids.planes_of(values, count), centroids.plane_weights(count)
        assert (centroids.distances(words, words[:7], weights) == ((values[:, None] - values[None, :7]) ** 2).sum(axis=2)).all()
        assert (centroids.sums(words, weights) == values.sum(axis=0)).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_plain(spark, kind):
    rng = np.random.default_rng(8)
    around = rng.normal(size=(6, 64))
    rows = [(i, (around[i % 6] + 0.3 * rng.normal(size=64)).astype(np.float32).astype(float).tolist()) for i in range(200)]
    same = rows[4][1]
    rows += [(i, same) for i in range(300, 390)] + [(4, same), (None, same), (None, rows[9][1])]
    rows += [(400, None), (401, []), (402, [0.5] * 63), (403, [0.5] * 65), (404, [0.5] * 63 + [None]), (405, [math.nan] * 64), (406, [math.inf] * 64), (407, [0.0] * 64), (408, [-40.0] * 64)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("extra")).repartition(4)
    setting = centroids.Setting(clusters=5, rounds=4, seed="7")
    found = centroids.clusters(frame, setting=setting)
    assert Counter(map(tuple, found.collect())) == plain_clusters(rows, setting)


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-1.0] * 64)]
    found = centroids.clusters(spark.createDataFrame(few, schema))
    assert Counter(map(tuple, found.collect())) == plain_clusters(few, centroids.Setting())
    for none in ([], [(1, None), (2, [1.0])]):
        assert centroids.clusters(spark.createDataFrame(none, schema)).collect() == []
    with pytest.raises(ValueError, match="beyond"):
        centroids.clusters(spark.createDataFrame([(1, [1e30] * 64)], schema))
    with pytest.raises(ValueError, match="clashes"):
        centroids.clusters(spark.createDataFrame(few, schema).withColumnRenamed("vec_id", "distance"), key="distance")


# --- exact copies


def plain_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_copies(rows):
    groups: dict[str, list] = {}
    for key, text in rows:
        groups.setdefault(plain_text(text), []).append(key)
    out, met = Counter(), set()
    for key, text in rows:
        own = groups[plain_text(text)]
        keep = min((k for k in own if k is not None), default=None)
        stays = key == keep and (plain_text(text), key) not in met
        met.add((plain_text(text), key))
        out[key, keep, len(own), stays, brute.sha(plain_text(text))] += 1
    return out


def copies():
    rng = random.Random(2)
    base = [talk(rng, rng.randrange(30)) for _ in range(60)]
    rows = [(i, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\t\n", "\x0b\x0c\r"]))) for i in range(300)]
    rows += [(i, "the same  text") for i in range(400, 550)]
    rows += [(600, None), (601, ""), (602, " "), (603, "\n\t"), (604, " a"), (605, "a"), (606, "a "), (607, " a"), (608, "\x00"), (609, "\x00\x00")]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (3, "another"), (None, "a"), (None, "only without id"), (None, "only without id")]
    return rows


def test_copies_equal_plain(spark):
    rows = copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(7)
    found = exact.duplicates(frame)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_copies(rows)
    left = exact.deduplicated(frame)
    assert left.columns == frame.columns
    stays = Counter({(k, sha): n for (k, _, _, kept, sha), n in plain_copies(rows).items() if kept})
    assert Counter((r["doc_id"], brute.sha(plain_text(r["text"]))) for r in left.collect()) == stays


def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "PRIMES", (3, 2))
    monkeypatch.setattr(exact, "CHUNK", 16)
    rows = copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert exact.prints(frame).select("_print").distinct().count() <= 6
    assert Counter(map(tuple, exact.duplicates(frame).collect())) == plain_copies(rows)


def test_huge_texts_are_hashed_in_chunks_elsewhere(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("ab  \n\té") for _ in range(70_000))
    rows = [(1, long), (2, plain_text(long)), (3, long + "."), (4, "." + long), (5, " " * 40_000), (6, " "), (7, "short"), (8, long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r["_key"]: tuple(r) for r in exact.prints(frame).collect()}
    monkeypatch.setattr(exact, "CHUNK", 1000)
    monkeypatch.setattr(exact, "HUGE", 5000)
    monkeypatch.setattr(exact, "HELD_BYTES", 60_000)
    assert {r["_key"]: tuple(r) for r in exact.prints(frame).collect()} == whole
    assert Counter(map(tuple, exact.duplicates(frame).collect())) == plain_copies(rows)


def test_fingerprints_compose():
    hasher, rng = exact.Hasher(), random.Random(6)
    data = rng.randbytes(50_000)
    for base, prime, own in zip(exact.BASES, exact.PRIMES, hasher.of(data[:3000])):
        number = 0
        for byte in data[:3000]:
            number = (number * base + byte) % prime
        assert number == own
    for cut in (0, 1, 8191, 8192, 20_000, 50_000):
        assert exact.joined(hasher.of(data[:cut]), hasher.of(data[cut:]), len(data) - cut) == hasher.of(data)


def test_normalising_by_chunks(monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 3)
    rng = random.Random(9)
    for _ in range(3000):
        data = bytes(rng.choice(b" \t\n\x0b\x0c\rabc") for _ in range(rng.randrange(20)))
        parts = list(exact.normalised(data))
        assert b"".join(parts) == re.sub(rb"[\x20\x09-\x0D]+", b" ", data)
        assert all(len(p) == 3 for p in parts[:-1])


def test_copies_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert exact.duplicates(frame).collect() == [] and exact.deduplicated(frame).collect() == []
    with pytest.raises(ValueError):
        exact.duplicates(frame.withColumnRenamed("doc_id", "kept"), key="kept")

"""Operator 3: language identification by words first, then ever shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is read
from its start: the longest known character n-gram at a place adds its log
frequency, and where none is known the next shorter one is tried; an unknown
single character adds nothing.

The model is fitted on a sample of labelled rows (`TRAIN_ROWS` a language at
most) and holds `WORDS` words and `GRAMS` n-grams a language at most, so it can
be broadcast whatever the corpus size. Prediction reads the whole text.

A null text and a text without a letter is `und` with score 0, as is any text
when nothing could be learned. Ties go to the language whose name sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import TABLE_ENTRIES, batches, bounded_sample, checkpointed

TRAIN_ROWS = 3000
WORDS = 20_000
GRAMS = 20_000
ORDERS = 5
SMOOTHING = 0.5
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def grams_of(word: str):
    padded = f"^{word}$"
    for order in range(1, ORDERS + 1):
        for i in range(len(padded) - order + 1):
            yield padded[i : i + order]


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies, one row per entry and one column per language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """The model of the rows with a text and a language."""
    known = labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.col(key).alias("_key"))
    sample = bounded_sample(known.where("_lang is not null and _text is not null"), "_lang", rows, "_key")

    def each():
        def step(part):
            counts: dict[str, Counter] = {}
            for language, x in zip(part.column("_lang").to_pylist(), part.column("_text").to_pylist()):
                counts.setdefault(language, Counter()).update(words_of(x))
            rows = []
            for language, words in counts.items():
                grams = Counter()
                for word, n in words.items():
                    for gram in grams_of(word):
                        grams[gram] += n
                rows += [(language, 0, w, n) for w, n in words.items()]
                rows += [(language, len(g), g, n) for g, n in grams.items()]
            yield {c: [r[i] for r in rows] for i, c in enumerate(("lang", "size", "entry", "n"))}

        return step

    counted = batches(sample, "lang string, size int, entry string, n long", each)
    counted = checkpointed(counted.groupBy("lang", "size", "entry").agg(F.sum("n").alias("n")))
    kind = F.col("size") > 0
    order = Window.partitionBy("lang", kind).orderBy(F.desc("n"), "size", "entry")
    most = F.when(kind, F.lit(GRAMS)).otherwise(F.lit(WORDS))
    # Some thousand entries a language; the sample above bounds what each window sorts.
    top = counted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank").collect()
    totals = {(r["lang"], r["size"]): r["n"] for r in counted.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    return _model(top, totals)


def _model(top, totals) -> LanguageModel:
    languages = sorted({lang for lang, _ in totals})
    column = {lang: i for i, lang in enumerate(languages)}
    entries = sorted({(r["size"], r["entry"]) for r in top})
    place = {x: i for i, x in enumerate(entries)}
    counts = np.full((len(entries), len(languages)), SMOOTHING)
    for r in top:
        counts[place[r["size"], r["entry"]], column[r["lang"]]] += r["n"]
    sizes = np.array([size for size, _ in entries], int)
    whole = np.array([[totals.get((lang, s), 0) for lang in languages] for s in range(ORDERS + 1)], float)
    kinds = np.bincount(sizes, minlength=ORDERS + 1)[:, None] if len(sizes) else np.zeros((ORDERS + 1, 1))
    logs = np.log(counts) - np.log(whole + SMOOTHING * kinds + 1e-9)[sizes] if languages else counts
    words = {x: i for (size, x), i in place.items() if size == 0}
    grams = {x: i for (size, x), i in place.items() if size > 0}
    return LanguageModel(languages, words, grams, logs)


class Scorer:
    """Scores texts; unseen words' backoff scores are kept in a bounded table."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known = dict(model.words)
        self.rows = [model.logs]
        self.all = model.logs

    def backoff(self, word: str) -> np.ndarray:
        padded, at, total = f"^{word}$", 0, np.zeros(len(self.model.languages))
        while at < len(padded):
            for order in range(min(ORDERS, len(padded) - at), 0, -1):
                row = self.model.grams.get(padded[at : at + order])
                if row is not None:
                    total = total + self.model.logs[row]
                    at += order
                    break
            else:
                at += 1
        return total

    def learn(self, words: set[str]) -> None:
        if len(self.known) > len(self.model.words) + TABLE_ENTRIES // 2:
            self.known, self.all = dict(self.model.words), self.model.logs
        new = sorted(words.difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.all), len(self.all) + len(new))))
            self.all = np.concatenate([self.all, [self.backoff(w) for w in new]])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(x) for x in texts]
        if self.model.languages:
            self.learn(set().union(*split))
        names, scores = [], []
        for words in split:
            if not words or not self.model.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.all[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns, `lang_pred` and `score` (or other `names` for them), for every row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams, model.logs))
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` string, `{names[1]}` double"])

    def each():
        scorer = Scorer(LanguageModel(*sent.value))

        def step(part):
            found = scorer.predict(part.column("_text").to_pylist())
            yield {**{c: part.column(c) for c in keep}, **dict(zip(names, found))}

        return step

    return batches(docs.select(*keep, F.col(text).alias("_text")), schema, each)

from __future__ import annotations

import brute
import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F

from storelens.llm import language, quality
from storelens.llm.common import held_out
from storelens.llm.registry import tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents and what each stage returned, written and read again."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, "12 !", "en", "x", 0), (9004, docs.first()["text"], "en", "y", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"score": F.lit(1), "name": F.lit("n"), "_id": F.lit(2)})
    frames = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(number))
        stage(spark, frames[-1], SMALL).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_keep_columns_and_values(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns
        whole = set(before.collect())
        assert all(r in whole for r in after.collect())


def test_language_stage(stages):
    docs, kept = stages[0], texts(stages[1])
    scorer = language.Scorer(language.fit(docs.where(~held_out())))
    for doc, text in texts(docs).items():
        (name,), (score,) = scorer.predict([text])
        assert (doc in kept) == (name != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE)


def test_quality_stage(spark, stages):
    docs, kept = stages[1], texts(stages[2])
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    field = quality.fit(docs.where(~held_out()), labels)
    for doc, text in texts(docs).items():
        ((sizes, good),) = quality.line_marginals([text], field)
        assert (doc in kept) == ((sizes * good).sum() / sizes.sum() >= quality.THRESHOLD)
    named = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [d for d in texts(docs) if named.get(d) == 1]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)


def test_near_duplicate_stage(stages):
    docs = texts(stages[2])
    wanted = brute.jaccard_groups(docs, 5, 80, 100)
    assert sorted(texts(stages[3])) == sorted(d for d, (_, c) in wanted.items() if c == d)


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = texts(stages[3])
    assert sorted(texts(stages[4])) == sorted(d for d, t in docs.items() if not brute.hits(t, items)[1])


def test_last_stage(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in stages[5].collect()}
    docs = texts(stages[4])
    assert set(found) == set(docs)
    for doc, text in docs.items():
        ids = library.encode(text)
        assert found[doc]["ids_sha256"] == brute.sha(",".join(map(str, ids)))
        assert found[doc]["decoded_sha256"] == brute.sha(library.decode(ids))


def test_run_equals_the_stages_and_takes_nothing(spark, tmp_path):
    run = corpus_pipeline.run(spark, SMALL)
    assert run.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and run.count() > 50
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

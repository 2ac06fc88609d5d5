"""Searches by feedback where the first results by words have no vector: those that have one lie further down, or nowhere."""

from __future__ import annotations

import oracle
import pytest

from scholion.plans import retrieval


def corpus(spark, folder, first_vector):
    """Sixty documents of all words before forty of one; vectors are numbered from ``first_vector``."""
    texts = ["speech recognition with beam search finding agrees with earlier benchmarks"] * 60 + [f"speech finding {'filler ' * (i % 7)}" for i in range(40)] + ["", None]
    data = [(i, text, "en" if i % 5 else "de", 2000 + i % 20) for i, text in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, pub_year int").write.parquet(f"{folder}/documents.parquet")
    vectors = [(first_vector + i, [1.0, 0.5 * i, float(i * i % 11)] if i % 9 else None, i % 4) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["prf_research", "search_pipeline", "rrf_fusion"])
@pytest.mark.parametrize("first_vector", [60, 1000])
def test_feedback_reaches_behind_the_first_results(spark, tmp_path, name, first_vector):
    at = corpus(spark, tmp_path, first_vector)
    df = retrieval.QUERIES[name](spark, at)
    assert oracle.compare(oracle.connection(at), df, retrieval.SQL[name]) is None
    assert (df.count() > 0) == (name != "prf_research" or first_vector == 60)

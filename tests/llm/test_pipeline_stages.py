"""Stages of the pipeline against brute force, on cases of their own."""

import random

import corpus_pipeline as cp
from tests.llm.conftest import SCHEMA
from tests.llm.test_corpus_ops import brute_components, near_copies


def test_near_copies_at_five_words(spark):
    """Copies with an appended passage: below 0.9 in three words, above 0.8 in five."""
    rng = random.Random(3)
    texts = [t for _, t in near_copies()]
    for _ in range(5):
        text = [f"p{rng.randint(0, 10**6)}" for _ in range(100)]
        texts += [" ".join(text), " ".join(text + [f"q{rng.randint(0, 10**6)}" for _ in range(18)])]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in cp.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {c for _, _, c in brute_components(rows, 80, 5)}
    assert kept < {c for _, _, c in brute_components(rows, 90, 3)}

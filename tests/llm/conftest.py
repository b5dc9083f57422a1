import os
import random

import pytest

WORDS = ["the", "of", "and", "to", "in", "that", "is", "was", "he", "for", "it", "with", "as", "his", "on", "be", "at", "by", "i", "this"]


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def prose():
    """Texts of ``n`` words that a seed decides."""

    def make(seed, n, words=WORDS):
        r = random.Random(seed)
        return " ".join(r.choice(words) + (str(r.randrange(30)) if r.random() < 0.3 else "") for _ in range(n))

    return make


@pytest.fixture
def frame(spark):
    """Documents over several tasks, with columns whose names clash with the operators' own."""

    def make(rows, parts=3):
        data = [(i, t, "slice", 1, "v") for i, t in rows]
        return spark.createDataFrame(
            data, "doc_id long, text string, bucket string, u int, kept string"
        ).repartition(parts)

    return make

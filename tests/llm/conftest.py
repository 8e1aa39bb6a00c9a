from __future__ import annotations

import random

import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, a missing id, repeated rows, one long text, odd characters."""
    random.seed(7)
    long = " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) + str(random.randint(0, 999)) for _ in range(60_000))
    return [
        (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "don't  stop\x1c naïve ½ 漢字 🙂 <|endoftext|>"), (6, long), (6, long),
        (7, "x" * 5000), (None, "a row without an id, of nine words in all"), (8, "a row without an id, of nine words in all"), (9, "A\u0000b"),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names operators use for themselves."""
    rows = [(d, t, "k", 1.5, [1], "z") for d, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, node double, words array<int>, mark string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

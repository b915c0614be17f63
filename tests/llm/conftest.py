import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fleetveil.llm.common import ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"

# Columns beyond those of documents carry names that the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, ids string, n int, "
    "token string, kept string, digest string, line string, component string, block string, "
    "words string, key string, row string, grp string, toxic string, score string"
)
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids."""
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG + " tail"),
        (7, "alpha beta gamma delta epsilon zeta"), (8, "alpha beta  gamma delta\tepsilon zeta"),
        (7, "alpha beta gamma delta epsilon zeta"), (None, "alpha beta gamma delta epsilon zeta"),
        (None, None), (9, "ünï cödé 😀 𝒳   x y <|endoftext|> z" * 3),
        (10, "#" * 500), (11, "a\nb c d e f g\nb c d e f g\n\nB  c D e f G\nx"), (12, "x" * 70_000),
    ]
    rows = [
        (i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, *["clash"] * 1, None, *["clash"] * 12)
        for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rep long, copy string, bucket string, rest string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts and languages, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(4)
    base, long_ = prose(rng, 120), prose(rng, 9000)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), "", None, long_, prose(rng, 3), "a", " \n ", "x" * 70, base[100:400], "  two  spaces\t\n\n", "*** ### !!!", "é" * 60 + base[:80]]
    rows = [(i, t, ["en", "fr", None][i % 3], None, None, 1, i, "c", "b", "r") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0]]  # repeated rows
    rows += [(None, base, "en", "s", 1, 1, 1, "c", "b", "r"), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Those rows as a table with columns whose names clash with the operators' own."""
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}

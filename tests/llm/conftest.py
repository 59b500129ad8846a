from __future__ import annotations

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "s", 35),
        (1, "Alpha beta gamma delta epsilon zeta", "en", "s", 35),
        (2, "alpha beta gamma delta epsilon ZETA", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (5, " \t\n ", "en", "s", 4),
        (None, "alpha beta gamma delta epsilon zeta", "en", "s", 35),
        (6, long, "en", "s", len(long)),
        (7, long + " tail", "en", "s", len(long) + 5),
        (8, "two words", "en", "s", 9),
        (9, "É ü ß ñ 😀 ▁ mark", "fr", "s", 16),
    ]
    extra = "node string, key int, rep int, shard int, kept int, kept_id int, listed_id int, digest int, text_sha256 int"
    return spark.createDataFrame([(*r, "n", *range(8)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

"""Texts and tables that every operator must bear."""

from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "alpha beta gamma delta " * 20_000

#: ids repeat, ids and texts are null, rows repeat, texts are empty, blank or very long.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the hounds"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the hounds"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, "the quick brown fox jumps over the lazy dog and runs away from all of the hounds"),
    (5, LONG),
    (6, "Ünï cödé 漢字 \U0001f600 wörds"),
    (1, "another text under the same id"),
    (None, None),
]


def frame(spark, rows=ROWS, clash: tuple[str, ...] = ()):
    """``(doc_id, text)`` and further columns of the given names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in clash:
        df = df.selectExpr("*", f"'own' AS `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")

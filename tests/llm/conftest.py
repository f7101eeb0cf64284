import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
LONG = "word and another " * 40_000

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, spans string, lang_pred string"
EDGE = [
    (1, "The cat sat on the mat and then it ran away over the hill", "en", "a", 1, "k", "s", "p", "l"),
    (2, "The  cat sat on the\tmat and then it ran away over the hill", "en", "a", 1, "k", "s", "p", "l"),
    (2, "The  cat sat on the\tmat and then it ran away over the hill", "en", "a", 1, "k", "s", "p", "l"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "k", "s", "p", "l"),
    (5, " \t\n", None, "b", 0, "k", "s", "p", "l"),
    (6, LONG, "en", None, 1, "k", "s", "p", "l"),
    (7, "x" * 100_000, "en", "b", 1, "k", "s", "p", "l"),
    (8, "12 34 !!", "de", "c", 1, "k", "s", "p", "l"),
    (None, "Der Hund und die Katze", "de", "c", 1, "k", "s", "p", "l"),
    (None, "Der Hund und die Katze", "de", None, 1, "k", "s", "p", "l"),
    (9, "приветмир \U0001f642 ▁ \x00 日本語", "ru", "c", 1, "k", "s", "p", "l"),
    (10, "three words here", "en", "c", 1, "k", "s", "p", "l"),
    (11, "THREE words here", "en", "c", 1, "k", "s", "p", "l"),
]


@pytest.fixture()
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)

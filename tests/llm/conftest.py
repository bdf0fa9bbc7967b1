import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

#: rows that every operator on documents has to stand
ODD_TEXTS = [None, "", " \t\n", "word", "a " * 300 + "b", "x" * 5000, "É ñ ß 東京 🙂 <|endoftext|>", "one\ntwo\n\nthree\n"]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "no id here", None, 0), (4, "another text under a used id", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, pos int").withColumnsRenamed({"pos": "h"})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, h int")

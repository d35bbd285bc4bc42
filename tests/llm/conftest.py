import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with an extra column whose name could clash."""

    def build(rows):
        full = [(d, t, "en", "s", None if t is None else len(t), 1) for d, t in rows]
        return spark.createDataFrame(full, DOCS + ", _id int")

    return build


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

"""Small frames shared by the tests of the training-data operators."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like frame from texts (ids from 0) or (id, text) pairs."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        if not extra:
            return spark.createDataFrame(rows, DOCS)
        # names that the operators use inside
        more = ", row int, key string, h int, score double, spans string, base int, ids int, `a b` int, held_out int"
        return spark.createDataFrame([(*r, 1, "k", 2, 0.5, "s", 3, 4, 5, 6) for r in rows], DOCS + more)

    return make


@pytest.fixture(scope="session")
def small_texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]

from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows, more: str = ""):
        return spark.createDataFrame([(*r,) for r in rows], "doc_id long, text string" + more)

    return make

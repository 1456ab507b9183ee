from __future__ import annotations

import datetime as dt

import pytest

from tests import oracle


@pytest.fixture(scope="session")
def spark():
    return oracle.session()


@pytest.fixture(scope="session")
def at():
    """A UTC time a number of seconds after a fixed start."""
    start = dt.datetime(2025, 1, 1)
    return lambda s: start + dt.timedelta(seconds=s)


@pytest.fixture(scope="session")
def chunk(spark):
    """Chunk rows as the vector store's tests use them."""
    schema = (
        "id string, document_id string, user_id string, text string, section string, page_start int, page_end int, "
        "chunk_index int, company string, fiscal_period string, report_type string, embedding array<float>"
    )

    def rows(*specs):
        data = [
            (i, doc, user, f"text for {i}", "MD&A", 1, 2, 0, "Acme", "FY2025", "10-K", vec) for i, doc, user, vec in specs
        ]
        return spark.createDataFrame(data, schema)

    return rows

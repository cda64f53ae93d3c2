"""The llm queries on the smallest tables: against their SQL, or rows of a stable schema."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, rows_of, rows_of_sql  # noqa: E402

from tessella.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = rows_of(QUERIES[name](spark, data))
    if name in SQL:
        assert got == rows_of_sql(connect(data), SQL[name])


def test_every_document_is_encoded(spark, data):
    assert QUERIES["p8_ids"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parents[2])]

import pytest


@pytest.fixture(scope="session")
def redactor(spark):
    """Trees fit on the shared documents."""
    from sievework.llm import pii

    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))

import pytest

from listwatch.llm.common import Scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

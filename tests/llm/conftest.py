import pytest
from llm_cases import EDGE, as_docs


@pytest.fixture(scope="session")
def edge(spark):
    return as_docs(spark, EDGE)


@pytest.fixture(scope="session")
def nothing(spark):
    return as_docs(spark, [])

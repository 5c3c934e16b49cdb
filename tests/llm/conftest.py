import pytest

from hindcast.llm._shared import prepare


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)

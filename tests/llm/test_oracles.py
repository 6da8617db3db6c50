import pytest

from siftloom.llm import registry
from tests.compare import same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], DIR)

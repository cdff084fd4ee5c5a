"""The contract of the queries of this subpackage."""

import re

import __spark_entry__
from lodestrata.llm import queries


def test_one_query_for_each_operator_and_the_pipeline():
    found = __spark_entry__.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in found and set(queries.ORACLES) < set(queries.QUERIES)
    assert set(__spark_entry__.oracle_sql()) < set(found)

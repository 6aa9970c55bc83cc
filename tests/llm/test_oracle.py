"""Every statement of the subpackage against its query, and what the entry registers."""

import pytest

from checks.compare import canon
from playcohort.llm.queries import QUERIES
from playcohort.llm.sql import ORACLE


@pytest.mark.parametrize("key", list(ORACLE))
def test_query_matches_sql(spark, duck, sf, key):
    df = QUERIES[key](spark, sf)
    cursor = duck.execute(ORACLE[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cursor.fetchall(), names)

"""The problems' queries run on the smallest tables; where they have SQL, their rows are those of the SQL."""

import pytest
from oracle import spark_rows, sql_rows

catalogue = pytest.importorskip("lorekeep.llm.catalogue")


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(catalogue.QUERIES[name](spark, sf_dir))
    if name in catalogue.ORACLE_SQL:
        assert got == sql_rows(sf_dir, catalogue.ORACLE_SQL[name])
    assert got[1]

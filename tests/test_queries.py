"""Every query of the engine runs; where it has SQL, its rows are those of the SQL."""

import pytest
from oracle import spark_rows, sql_rows

from lorekeep.plans.catalogue import NAMES, QUERIES, SEARCHES, oracle_sql

# nothing in the smallest tables gives these a row: no page is an index; see test_index
EMPTY = {"index_entries", "index_hint_boosts"}
# searches whose SQL compares every question with every chunk take every fourth question here
EVERY = 4


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    more = {"every": EVERY} if name in SEARCHES else {}
    got = spark_rows(QUERIES[name](spark, sf_dir, **more))
    sql = oracle_sql(EVERY)
    if name in sql:
        assert got == sql_rows(sf_dir, sql[name])
    assert got[1] or name in EMPTY


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    found = entry.entry(spark)
    assert found.columns[0] == "question_id" and found.count() > 100


@pytest.fixture(scope="module")
def indexed(spark, sf_dir, tmp_path_factory):
    """The smallest tables with an index at the end of one book."""
    import os
    import shutil

    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("indexed")
    for f in os.listdir(sf_dir):
        if f != "pages.parquet":
            shutil.copy(os.path.join(sf_dir, f), folder / f)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    doc = pages.groupBy("doc_id").count().orderBy(F.desc("count"), "doc_id").first().doc_id
    words = ["points .... 2, 4", "Cost 3", "wounded scout 1, 1, 2", "Initiative track…… 5", "broken seal 2", "bell 3", "see Magic 3", "12. Foo 3", "companion (ally) 1", "Cost 4"]
    rows = [("## Index\n" + "\n".join(words)), "Index of nothing\n\nbody"]
    late = pages.where(F.col("doc_id") == doc).agg(F.max("page_number").alias("n"), F.max("ingested_at").alias("t"), F.first("library_id").alias("l")).first()
    extra = spark.createDataFrame([(doc, late.n + 1 + i, late.l, c, late.t) for i, c in enumerate(rows)], "doc_id string, page_number int, library_id string, content string, ingested_at timestamp")
    pages.unionByName(extra.select(pages.columns)).toPandas().to_parquet(folder / "pages.parquet", coerce_timestamps="us", index=False)
    return str(folder)


@pytest.mark.parametrize("name", ["index_entries", "index_hint_boosts", "hybrid_retrieve", "hybrid_all_lanes"])
def test_index(spark, indexed, name):
    more = {"every": EVERY} if name in SEARCHES else {}
    got = spark_rows(QUERIES[name](spark, indexed, **more))
    assert got[1] and got == sql_rows(indexed, oracle_sql(EVERY)[name])

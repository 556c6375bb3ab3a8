"""The SQL client against the Derby database that comes with Spark."""

import uuid

from lathe.sources import sql


def test_ranges_pushes_and_ways_back(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    rows = [(i if i % 50 else None, f"n{i}\t\\", i / 4) for i in range(1, 1001)]
    sql.write_table(spark.createDataFrame(rows, "id long, name string, x double"), url, "ITEMS", createTableColumnTypes="name VARCHAR(50)")
    t = sql.read_table(spark, url, "ITEMS", "id", 4)
    assert t.rdd.getNumPartitions() == 4
    assert sorted((r.id, r.name, r.x) for r in t.collect() if r.id) == sorted(r for r in rows if r[0])
    assert t.where("id IS NULL").count() == 20  # rows without a key are in the first range
    low = t.where("x < 10 AND id > 3")
    assert "PushedFilters: [x IS NOT NULL, id IS NOT NULL, x < 10.0, id > 3]" in low._jdf.queryExecution().executedPlan().toString()
    assert low.count() == sum(1 for i, _, x in rows if i and x < 10 and i > 3)
    whole = sql.read_table(spark, url, "ITEMS").groupBy().count()
    assert "PushedAggregates: [COUNT(*)]" in whole._jdf.queryExecution().executedPlan().toString() and whole.head()[0] == 1000  # the server counts
    assert sql.count_ledger(spark, url, ["ITEMS"]).collect() == [("ITEMS", 1000)]
    assert sql.tsv_lines(sql.query(spark, url, 'SELECT "id", "name" FROM ITEMS WHERE "x" < 0.3 OR "x" = 12.5')).orderBy("line").collect() == [("1\tn1\\t\\\\",), ("NULL\tn50\\t\\\\",)]
    sql.write_table(spark.createDataFrame([(7, "y", 1.0)], "id long, name string, x double"), url, "ITEMS", "append")
    assert sql.query(spark, url, 'SELECT count(*) AS n FROM ITEMS WHERE "id" = 7').head()[0] == 2


def test_empty_table_and_one_key(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    sql.write_table(spark.createDataFrame([], "id long"), url, "EMPTY")
    assert sql.read_table(spark, url, "EMPTY", "id").collect() == []
    sql.write_table(spark.createDataFrame([(5,), (5,)], "id long"), url, "ONE_KEY")
    assert len(sql.read_table(spark, url, "ONE_KEY", "id").collect()) == 2

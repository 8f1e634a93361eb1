"""Large tables in few row groups: rows are dealt by key, and long values are computed once."""

from pyspark.sql import functions as F

from quillstone.functions.codes import normalize_device_code
from quillstone.functions.dates import normalize_date
from quillstone.plans import ledger as L


def formatted(plan):
    return plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_is_computed_once(spark):
    rows = spark.createDataFrame([("12",), (" nUlL ",), ("1e2",), ("x",), ("NULLS",)], "v string")
    for numeric in (None, F.lit(True)):
        found = rows.select("v", normalize_device_code(F.concat("v", F.lit("-marker-")), numeric, F.lit("0000")).alias("json"))
        assert formatted(found).count("-marker-") == 1
    got = dict(rows.select("v", normalize_device_code(F.col("v"), F.col("v").isin("12", "1e2"), F.lit("0000"))).collect())
    assert got == {"12": '{"注册代码":"0012"}', " nUlL ": None, "1e2": '{"注册代码":"0100"}', "x": '{"注册代码":"x"}', "NULLS": '{"注册代码":"NULLS"}'}


def test_a_row_group_keeps_several_tasks_busy(spark, tmp_path):
    n = 200_000
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 100_003).alias("o_custkey"), F.lit("2-HIGH").alias("o_orderpriority"), F.timestamp_seconds("id").alias("o_orderdate"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    parts = L.ledger(spark, str(tmp_path)).select("row_num", "d1").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == n


def test_dates_that_cannot_be(spark):
    texts = {"2020-13-01": None, "2020-00-10": None, "2020-1-32": None, "2020-1-0": None, "2021-2-29": None, "2020.2.29": "2020-02-29", "2020/12/31": "2020-12-31", "20201301": None, "20201231": "2020-12-31", "0000-1-1": None, "0001-1-1": "0001-01-01", "9999-W52-5": "9999-12-31"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_date(F.col("t")).alias("d"))
    assert {r.t: r.d.value for r in rows.collect()} == texts

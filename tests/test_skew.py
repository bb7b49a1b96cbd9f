"""A third of all facts on one key: partitions are split, and the result stays whole."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from catalog import standins as s

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def hot_tables(spark, folder, rows=300_000):
    number = F.col("id")
    spark.range(0, rows, 1, 16).select(
        number.alias("o_orderkey"),
        F.when(number % 3 == 0, 42).otherwise(number % 1000).cast("long").alias("o_custkey"),
        F.when(number % 2 == 0, "F").otherwise("P").alias("o_orderstatus"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.hash("id") % 500).cast("int")).alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders")
    spark.range(1000).select(
        number.alias("c_custkey"), (number % 25).cast("int").alias("c_nationkey"), F.lit("x").alias("c_mktsegment")
    ).write.parquet(f"{folder}/customer")
    nation = spark.range(25).select(number.cast("int").alias("n_nationkey"), (number % 5).cast("int").alias("n_regionkey"),
                                    F.lit("n").alias("n_name"))
    nation.write.parquet(f"{folder}/nation")
    return SimpleNamespace(**{n: spark.read.parquet(f"{folder}/{n}") for n in ("orders", "customer", "nation")})


def test_hot_customer(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    try:
        tables = hot_tables(spark, str(tmp_path))
        daily = s.history_daily(tables)
        rows = daily.collect()
        text = daily._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "SortMergeJoin(skew=true)" in text
    assert sum(r.AnzFallErkrankung for r in rows) == 300_000
    last = {}
    for r in sorted(rows, key=lambda r: r.date):
        last[r.gemeinde] = r.KumFall
    # Customer 42 belongs to nation 17 and brings a third of all cases there.
    assert sum(last.values()) == 300_000 and last["17000"] > 100_000

from pyspark.sql import functions as F

from loomgrid.streaming import state


def test_state_over_several_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FILES_PER_BATCH", 1)
    rows = spark.range(3000).select((F.col("id") % 37).alias("k"), (F.col("id") * 7 % 3001).alias("v"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = state.keyed_state(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/at", "k", [F.min("v").alias("v"), F.count(F.lit(1)).alias("n")], [F.min("v").alias("v"), F.max("n").alias("n")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.groupBy("k").agg(F.min("v"), F.count("*")).collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_empty_stream(spark, tmp_path):
    spark.range(0).selectExpr("id as k", "id as v").write.parquet(f"{tmp_path}/in")
    got = state.keyed_state(spark, f"{tmp_path}/in", spark.range(0).selectExpr("id as k", "id as v").schema, f"{tmp_path}/at", "k", [F.min("v").alias("v")], [F.min("v").alias("v")])
    assert got.count() == 0

"""Frozen pipelines, streams and ensembles on small frames."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import ensembles, evaluation, linear, pipeline
from tessella.operators.trees import TreeConfig
from tessella.streaming import incremental

CFG = TreeConfig(rounds=4, rate=0.6, depth=3, leaves=8, bins=16)


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"), F.concat(F.lit("c"), F.col("id") % 5).alias("c"))
    return df.withColumn("y", F.col("a") + F.when(F.col("c") == "c3", 10.0).otherwise(0.0)).cache()


def test_pipeline_handles_unseen_and_missing(spark, table):
    p = pipeline.Pipeline("y", pipeline.PipelineConfig(bins=8)).fit(table, ["a", "c"])
    new = spark.createDataFrame([(None, "new"), (float("nan"), None), (3.0, "c3")], "a double, c string")
    out = pipeline.Pipeline.from_json(p.to_json()).transform(new).collect()
    assert out[0].bin_a == out[1].bin_a and out[0].bin_c == out[1].bin_c and len(out) == 3
    with pytest.raises(ValueError, match="missing columns: c"):
        p.transform(new.drop("c"))


def test_multilabel_learns_each_label(table):
    df = table.withColumns({"u": (F.col("a") > 8).cast("double"), "v": (F.col("a") % 2 == 0).cast("double")})
    out = ensembles.predict_multilabel(df, ensembles.train_multilabel(df, ["a"], ["u", "v"], CFG), ["u", "v"])
    assert out.agg(F.avg(((F.col("p_u") >= 0.5).cast("int") == F.col("u")).cast("double"))).first()[0] > 0.95


def test_stream_statistics_equal_the_batch(spark, table, tmp_path):
    table.select("k", "a").repartition(3).write.parquet(str(tmp_path / "in"))
    scaler = incremental.IncrementalScaler(["a"])
    stream = spark.readStream.schema("k long, a double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run(stream, scaler.update, str(tmp_path / "ck")).awaitTermination()
    n, mean, var = table.agg(F.count("a"), F.avg("a"), F.var_pop("a")).first()
    p = scaler.state.params["a"]
    assert p["n"] == n and abs(p["mean"] - mean) < 1e-9 and abs(p["m2"] / n - var) < 1e-9


def test_gate_refuses_a_shifted_batch(table):
    model = linear.train_universal(table, ["a"], "y", "k", "linear_then_trees", CFG)
    gate = incremental.GatedModel(model, table, 1)
    gate.update(table)
    gate.update(table.withColumn("a", F.col("a") + 100))
    assert gate.log == ["update", "retrain"] and len(gate.model.trees.trees) == 5


def test_modes_beat_the_mean(table):
    for mode in ("trees", "linear_then_trees", "forest"):
        out = linear.train_universal(table, ["a"], "y", "k", mode, CFG).predict(table)
        assert out.agg(evaluation.regression_metrics(F.col("y"), F.col("prediction"))["r2"]).first()[0] > 0.3


def test_stream_counts_are_a_table_and_batches_count_once(spark, table, tmp_path):
    table.select("k", "c").repartition(3).write.parquet(str(tmp_path / "in"))
    counts = incremental.IncrementalCounts("c", str(tmp_path / "counts"))
    stream = spark.readStream.schema("k long, c string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run(stream, counts.update, str(tmp_path / "ck")).awaitTermination()
    want = {r.c: r["count"] for r in table.groupBy("c").count().collect()}
    assert {r.c: r.n for r in counts.counts(spark).collect()} == want
    counts.update(table.limit(9), counts.latest)
    assert {r.c: r.n for r in counts.counts(spark).collect()} == want


def test_many_categories_are_joined(spark, table):
    df = table.withColumn("c", F.concat(F.lit("c"), F.col("k") % 100))
    small, large = (pipeline.Pipeline("y", pipeline.PipelineConfig(bins=8, least_count=1, literal=n)).fit(df, ["c"]) for n in (500, 10))
    rows = lambda p: sorted((r.k, round(r.c, 9)) for r in p.encode(df, ["k"]).collect())
    assert rows(small) == rows(large) and sorted(map(tuple, small.transform(df, ["k"]).collect())) == sorted(map(tuple, large.transform(df, ["k"]).collect()))


def test_frame_to_binned_table(table):
    out, fitted = pipeline.binned_table(table.drop("k").withColumn("same", F.lit(1)), "y", config=pipeline.PipelineConfig(bins=4))
    assert out.columns == ["y", "bin_a", "bin_c"] and [f.name for f in fitted.features] == ["a", "c"] and out.count() == 300

"""States that outlive their process, and journals of every model."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import auto, cohorts, linear, trees
from tessella.sources import models
from tessella.streaming import incremental
from tessella.streaming.state import Versions

TREE = trees.TreeConfig(rounds=2, rate=0.5, depth=2, leaves=4, bins=8)


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(240).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"), F.concat(F.lit("c"), F.col("id") % 5).alias("c"))
    return df.withColumn("y", F.col("a") + F.when(F.col("c") == "c3", 10.0).otherwise(0.0)).cache()


def batches(table):
    return [table.where(F.col("k") % 3 == i) for i in range(3)]


def test_counts_go_on_after_a_restart(spark, table, tmp_path):
    folder = str(tmp_path / "counts")
    for i, batch in enumerate(batches(table)):
        incremental.IncrementalCounts("c", folder).update(batch, i)  # a new object each time: nothing is left in memory
    want = {r.c: r["count"] for r in table.groupBy("c").count().collect()}
    counts = incremental.IncrementalCounts("c", folder)
    assert {r.c: r.n for r in counts.counts(spark).collect()} == want
    for retried in (2, 0):
        counts.update(batches(table)[retried], retried)
        assert {r.c: r.n for r in counts.counts(spark).collect()} == want


def test_a_torn_version_doesnt_count(spark, table, tmp_path):
    folder = tmp_path / "counts"
    first, second, _ = batches(table)
    incremental.IncrementalCounts("c", str(folder)).update(first, 0)
    incremental.IncrementalCounts("c", str(folder)).update(second, 1)
    (folder / "version-1" / "_SUCCESS").unlink()
    assert Versions(spark, str(folder)).done() == [0]
    counts = incremental.IncrementalCounts("c", str(folder))
    counts.update(second, 1)
    assert {r.c: r.n for r in counts.counts(spark).collect()} == {r.c: r["count"] for r in first.unionByName(second).groupBy("c").count().collect()}


def test_scaler_counts_a_retried_batch_once(spark, table, tmp_path):
    folder = str(tmp_path / "scaler")
    for i, batch in [*enumerate(batches(table)), (2, batches(table)[2]), (0, batches(table)[0])]:
        incremental.IncrementalScaler(["a"], folder=folder).update(batch, i)
    fresh = incremental.IncrementalScaler(["a"], folder=folder)
    fresh.resume(spark)
    n, mean, var = table.agg(F.count("a"), F.avg("a"), F.var_pop("a")).first()
    p = fresh.state.params["a"]
    assert p["n"] == n and abs(p["mean"] - mean) < 1e-9 and abs(p["m2"] / n - var) < 1e-9 and fresh.latest == 2
    held = incremental.IncrementalScaler(["a"])
    for _ in range(2):
        held.update(batches(table)[0], 0)
    assert held.state.params["a"]["n"] == batches(table)[0].count()
    for i in range(3, 9):
        fresh.update(table.limit(0), i)
    assert Versions(spark, folder).done() == [6, 7, 8]
    empty = incremental.IncrementalScaler(["a"], folder=str(tmp_path / "none"))
    empty.resume(spark)
    assert empty.state is None


def test_stream_killed_between_batches_ends_like_one_that_wasnt(spark, table, tmp_path):
    table.select("k", "c").repartition(4).write.parquet(str(tmp_path / "in"))
    folder, source = str(tmp_path / "counts"), lambda: spark.readStream.schema("k long, c string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    class Killed(Exception):
        pass

    def once(batch, batch_id):
        incremental.IncrementalCounts("c", folder).update(batch, batch_id)
        if batch_id == 1:
            raise Killed  # after the state's commit and before the stream's: the batch comes again

    with pytest.raises(Exception, match="Killed"):
        incremental.run(source(), once, str(tmp_path / "ck")).awaitTermination()
    after = incremental.IncrementalCounts("c", folder)
    incremental.run(source(), after.update, str(tmp_path / "ck")).awaitTermination()
    assert {r.c: r.n for r in after.counts(spark).collect()} == {r.c: r["count"] for r in table.groupBy("c").count().collect()}


def test_gated_model_resumes(spark, table, tmp_path):
    model = linear.train_universal(table, ["a"], "y", "k", "trees", TREE)
    gate = lambda: incremental.GatedModel(model, table, 1, folder=str(tmp_path / "gate"))
    gate().update(table, 0)
    gate().update(table.withColumn("a", F.col("a") + 100), 1)
    last = gate()
    last.update(table, 1)
    assert last.log == ["update", "retrain"] and len(last.model.trees.trees) == 3 and last.rule.history == [0.0, 1.0]


def predictions(model, df, column="prediction"):
    return model.predict(df).orderBy("k").select(column).collect()


def test_every_model_comes_back(spark, table, tmp_path):
    df = table.withColumns({"t": (F.col("a") > 8).cast("double"), "cls": F.when(F.col("a") < 5, "x").when(F.col("a") < 11, "y").otherwise("z"), "u": (F.col("c") == "c1").cast("double")})
    plain = auto.AutoConfig(tree=TREE, engineer=False, modes=("trees",))
    found = {
        "auto": auto.build(df.select("k", "a", "c", "y"), "y", "k", auto.AutoConfig(tree=TREE, modes=("linear_then_trees",))),
        "classes": auto.build(df.select("k", "a", "cls"), "cls", "k", plain),
        "multiclass": cohorts.train_multiclass(df.withColumn("n", (F.col("a") % 3).cast("int")), ["a"], "n", "k", 3, TREE),
        "labels": auto.build_labels(df, ["a"], ["t", "u"], "k", plain),
        "labels_linear": auto.build_labels(df, ["a"], ["t", "u"], "k", plain, mode="linear_then_trees"),
    }
    for name, model in found.items():
        models.save_model(spark, model, str(tmp_path / name))
        again = models.load_model(spark, str(tmp_path / name))
        if name == "multiclass":
            assert model.predict_proba(df).orderBy("k").select("p_2").collect() == again.predict_proba(df).orderBy("k").select("p_2").collect()
        else:
            column = "p_t" if name.startswith("labels") else "prediction"
            assert predictions(model, df, column) == predictions(again, df, column)
    with pytest.raises(ValueError, match="no saved form"):
        models.packed("model")


def test_journal_of_an_automatic_model(spark, table, tmp_path):
    df = table.select("k", "a", "c", "y")
    model = auto.build(df, "y", "k", auto.AutoConfig(tree=TREE, modes=("linear_then_trees",), engineer=False))
    journal = models.ModelJournal(spark, str(tmp_path / "j"))
    journal.save(model, 240)
    grown = model.update(df.where("k % 2 = 0"), 3)
    journal.update(grown, 120)
    last = grown.update(df, 1)
    journal.update(last, 240)
    again = models.ModelJournal(spark, str(tmp_path / "j"))
    assert again.versions() == [(0, "model", 240), (1, "update", 120), (2, "update", 240)]
    for version, want in ((0, model), (1, grown), (None, last)):
        assert predictions(again.load(version), df) == predictions(want, df) and again.load(version).trees() == want.trees()
    assert len(again.segments()[1]["payload"]) < len(models.packed(grown))
    other = auto.build(df, "y", "k", auto.AutoConfig(tree=TREE, modes=("trees",), engineer=False))
    assert again.update(other, 240) == 3 and again.versions()[-1][1] == "model" and predictions(again.load(), df) == predictions(other, df)

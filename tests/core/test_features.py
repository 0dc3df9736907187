import pytest
from pyspark.sql import functions as F

from assaylake.sources.features import FeatureStore


def cases(spark, names):
    return spark.createDataFrame([(n, f"content of {n}", "extra") for n in names], "source_sha256 string, content string, clash string").repartition(3)


def loader(log=None):
    def load():
        def run(contents):
            if log:
                with open(log, "a") as f:
                    f.write("".join(f"{c}\n" for c in contents))
            return [[float(len(c)), 1.5] for c in contents]

        return run

    return load


def test_second_run_extracts_nothing(spark, tmp_path):
    store, log = FeatureStore(spark, f"file://{tmp_path}/store"), str(tmp_path / "log")
    rows = cases(spark, ["a", "bb", "a"])
    out = store.features(rows, "m/1", lambda: "m/1", loader(log))
    assert sorted((r["source_sha256"], r["clash"], tuple(r["vector"])) for r in out.collect()) == [("a", "extra", (12.0, 1.5)), ("a", "extra", (12.0, 1.5)), ("bb", "extra", (13.0, 1.5))]
    assert sorted(open(log).read().split("\n")) == ["", "content of a", "content of bb"] and len(store.fragments()) == 1
    store.features(rows, "m/1", lambda: "m/1", loader(log))
    assert len(open(log).read().splitlines()) == 2 and len(store.fragments()) == 1
    store.features(cases(spark, ["a", "ccc"]), "m/1", lambda: "m/1", loader(log))
    assert len(open(log).read().splitlines()) == 3 and len(store.fragments()) == 2
    store.features(rows, "m/2", lambda: "m/2", loader(log))  # another extractor's features are no use
    assert len(open(log).read().splitlines()) == 5 and store.read("m/1").count() == 3 and store.read("m/2").count() == 2


def test_damage_and_conflict_fail(spark, tmp_path):
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    store.features(cases(spark, ["a", "b"]), "m/1", lambda: "m/1", loader())
    good = spark.read.parquet(*store.fragments())
    bent = good.withColumn("vector", F.when(F.col("source_sha256") == "a", F.array(F.lit(12.0), F.lit(1.25))).otherwise(F.col("vector")))
    bent.write.parquet(f"file://{tmp_path}/store/fragments/bent")
    with pytest.raises(Exception, match="FEATURE_DAMAGED a"):
        store.read("m/1").collect()
    other = FeatureStore(spark, f"file://{tmp_path}/other")
    other.publish(good.select("source_sha256", "identity", "vector"), "m/1")
    other.publish(bent.select("source_sha256", "identity", "vector"), "m/1")
    with pytest.raises(Exception, match="FEATURE_CONFLICT a"):
        other.read("m/1").collect()
    assert other.publish(bent.select("source_sha256", "identity", "vector"), "m/1") in [f.replace("file:/", "file:///") for f in other.fragments()] + other.fragments() and len(other.fragments()) == 2


@pytest.mark.parametrize("at", [1, 2, 3])
def test_changed_extractor_publishes_nothing(spark, tmp_path, at):
    """The identity changes before loading, after it, or while the extractor runs."""
    store, count = FeatureStore(spark, f"file://{tmp_path}/store"), str(tmp_path / "count")

    def observed():
        with open(count, "a") as f:
            f.write(".")
        return "m/2" if len(open(count).read()) >= at else "m/1"

    with pytest.raises(Exception, match="EXTRACTOR_CHANGED"):
        store.features(cases(spark, ["a"]).coalesce(1), "m/1", observed, loader())
    assert store.fragments() == []


def test_faulty_rows_are_not_published(spark, tmp_path):
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", "m/1", [1.0]), ("a", "m/1", [1.0])], "source_sha256 string, identity string, vector array<double>")
    with pytest.raises(ValueError, match="NOT_PUBLISHED"):
        store.publish(rows, "m/1")
    with pytest.raises(ValueError, match="NOT_PUBLISHED"):
        store.publish(rows.limit(1), "m/9")
    assert store.publish(rows.limit(0), "m/1") is None and store.fragments() == [] and store.read("m/1").count() == 0

import random

from pyspark.sql import functions as F

from corpusloom.operators import dedup as U


def test_first_valid_golden(spark):
    rows = [(1, "A", False), (2, "A", True), (3, "A", True), (4, "B", False), (5, "A", False), (6, None, True), (7, None, True)]
    out = {r["o"]: r["status"] for r in U.first_valid(spark.createDataFrame(rows, "o int, k string, valid boolean"), "k", ["o"]).collect()}
    assert out == {1: "skipped", 2: "accepted", 3: "duplicate", 4: "skipped", 5: "duplicate", 6: "accepted", 7: "accepted"}


def test_first_valid_like_the_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abcdefgh"), rnd.random() < 0.5) for i in range(300)]
    seen, want = set(), {}
    for i, k, ok in rows:
        want[i] = "duplicate" if k in seen else "accepted" if ok else "skipped"
        if want[i] == "accepted":
            seen.add(k)
    df = spark.createDataFrame(rows, "o int, k string, valid boolean").repartition(7)
    assert {r["o"]: r["status"] for r in U.first_valid(df, "k", ["o"]).collect()} == want


def test_quota_and_fold(spark):
    rows = [("s", i, f"k{i % 6}", True) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, o int, k string, valid boolean")
    assert sorted(r["o"] for r in U.source_quota(df, "s", ["o"], 5).collect()) == [0, 1, 2, 3, 4]
    a = df.drop("s")
    got = U.fold_sources([("one", a.where("o < 6"), 2), ("two", a, 3), ("off", a, 0)], "k", ["o"]).orderBy("source_name", "o").collect()
    assert [(r["source_name"], r["o"]) for r in got] == [("one", 0), ("one", 1), ("two", 2), ("two", 3), ("two", 4)]


def test_number_and_running_total(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), F.lit(2).alias("v")).repartition(9)
    ids = [r["id"] for r in U.number(df, "x-%04d", ["o"]).orderBy("o").collect()]
    assert ids == [f"x-{i:04d}" for i in range(1000)]
    assert [r["total"] for r in U.running_total(df, "v", ["o"]).orderBy("o").collect()] == [2 * (i + 1) for i in range(1000)]
    assert U.number(df.where("o < 0"), "x", ["o"]).count() == 0


def test_batches_and_counters(spark):
    b = U.full_batches(spark.range(70).withColumnRenamed("id", "o"), 32, ["o"]).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in b) == [(0, 32), (1, 32)]
    df = spark.createDataFrame([("a", "accepted", "ok"), ("a", "skipped", "short"), ("a", "skipped", "short"), ("b", "duplicate", "ok")], "source string, status string, reason string")
    c = {r["source"]: r for r in U.counters(df, ["source"]).collect()}
    assert c["a"]["skip_reasons"] == {"short": 2} and c["a"]["written"] == 1 and c["b"]["duplicates"] == 1 and c["b"]["skip_reasons"] is None


def test_first_occurrence(spark):
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (3, None, "z")], "o int, k string, v string")
    assert sorted(r["v"] for r in U.first_occurrence(df, "k", ["o"]).collect()) == ["y", "z"]

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing

SPECS = "name string, target_records bigint, max_repeats int"


def test_pivotal_keeps_sums_and_probabilities():
    rng = np.random.default_rng(1)
    p = np.array([0.3, 0.5, 0.2, 0.9, 0.1])
    hits = np.zeros(5)
    for _ in range(4000):
        out, held, mass = mixing.pivotal(p, rng.random(5))
        assert held == -1 or mass < 1e-6 or abs(mass - 1) < 1e-6
        full = out.copy()
        if held >= 0:
            full[held] += round(mass)
        assert full.sum() == 2
        hits += full
    assert np.abs(hits / 4000 - p).max() < 0.04
    assert mixing.pivotal(np.array([]), np.array([]))[1] == -1
    # Tiny masses add up: 20,000 records of 7e-10 copies each, in units of 1/10^12.
    out, held, mass = mixing.pivotal(np.full(20_000, 700, dtype=np.int64), rng.random(20_000), 10**12)
    assert out.sum() == 0 and held >= 0 and mass == 20_000 * 700
    out, held, mass = mixing.pivotal(np.full(4_000, 10**9, dtype=np.int64), rng.random(4_000), 10**12)
    assert out.sum() == 4 and held == -1
    assert mixing.pivotal(np.array([1.0, 0.0]), np.array([0.5, 0.5]))[0].tolist() == [1, 0]


def test_mix_with_hot_and_missing_sources(spark):
    rows = [("Hot-1", f"h{i}") for i in range(3000)] + [("small", f"s{i}") for i in range(10)] + [(None, "n"), ("hot_1", "h1"), ("off", "o1"), ("small", None)]
    specs = [("hot1", 50, 2), ("small", 50, 3), ("off", 0, 4), ("none", 10, 4), ("nothing", None, None)]
    r = spark.createDataFrame(rows, "source string, id string").withColumn("extra", F.lit(1))
    s = spark.createDataFrame(specs, SPECS).withColumn("copies", F.lit("clash"))
    out = {x["source"]: x for x in mixing.mix_report(r, s, leaf_rows=50, fan_in=4).collect()}
    assert (out["hot1"]["available"], out["small"]["available"]) == (3000, 10)
    for x in out.values():
        assert x["copies"] == x["planned"] and x["most"] <= max(x["max_repeats"], 0)
    assert {k for k, x in out.items() if x["short"]} == {"small", "none"}
    assert out["small"]["copies"] == 30 and out["off"]["copies"] == 0
    plan = mixing.plan_sources(r, s)
    a = mixing.mix(r, plan, leaf_rows=50).orderBy("skey", "id").collect()
    assert a == mixing.mix(r.repartition(5), plan, leaf_rows=50).orderBy("skey", "id").collect()
    assert len({x["id"] for x in a}) == len(a)


@pytest.mark.parametrize("with_specs", [True, False])
def test_empty_tables(spark, with_specs):
    s = spark.createDataFrame([("a", 5, 2)] if with_specs else [], SPECS)
    out = mixing.mix_report(spark.createDataFrame([], "source string, id string"), s).collect()
    assert [(x["source"], x["copies"], x["short"]) for x in out] == ([("a", 0, False)] if with_specs else [])

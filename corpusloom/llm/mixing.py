"""Mixing sources to target weights by pivotal dependent rounding.

Every record of a source has the same expected number of copies, its planned
total over its records.  The whole part is given at once; the fractional parts
are paired, and mass moves at random between the two of a pair until one of them
is 0 or 1.  Records are paired inside leaves of bounded size; what one record of
each leaf has left goes up a reduction tree of fan-in `fan_in`, so that the
copies of a source sum to its planned total exactly and no step sees more than a
leaf.  Masses are whole numbers in units of 1/records, so nothing is rounded away
however many records a source has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import name_key
from corpusloom.operators.skew import cut_lineage, hash_bucket

ROUNDED = "skey string, leaf int, id string, copy int, rest bigint, unit bigint"


def pivotal(p: np.ndarray, u: np.ndarray, unit: float = 1) -> tuple[np.ndarray, int, float]:
    """Round masses between 0 and `unit` to 0 or 1 unit by pairwise transfers, in order.

    `u` holds a uniform number per transfer.  Returns the rounded values in units, the
    place of the record that is left between 0 and a unit (-1: none) and its mass.
    With whole masses and unit every step is exact.
    """
    out = np.zeros(len(p), dtype=np.int64)
    held, a = -1, 0
    for j, (b, x) in enumerate(zip(p.tolist(), u.tolist(), strict=True)):
        if b <= 0 or b >= unit:
            out[j] = b >= unit
            continue
        if held < 0:
            held, a = j, b
            continue
        both = a + b
        if both < unit:
            if x * both < b:
                held = j
            a = both
        elif both == unit:
            out[held if x * unit < a else j] = 1
            held, a = -1, 0
        else:
            if x * (2 * unit - both) < unit - b:
                out[held], held = 1, j
            else:
                out[j] = 1
            a = both - unit
    return out, held, a if held >= 0 else 0


def _leaf(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable").reset_index(drop=True)
        u = np.random.default_rng([seed & 0xFFFFFFFF, int(pdf["leaf"].iloc[0]), len(pdf), int(pdf["h"].iloc[0]) & 0xFFFFFFFF]).random(len(pdf))
        copy, held, mass = pivotal(pdf["p"].to_numpy(), u, int(pdf["unit"].iloc[0]))
        rest = pd.Series(pd.NA, index=pdf.index, dtype="Int64")
        if held >= 0:
            rest.iloc[held] = mass
        return pd.DataFrame({"skey": pdf["skey"], "leaf": pdf["leaf"], "id": pdf["id"], "copy": copy, "rest": rest, "unit": pdf["unit"]})

    return run


def plan_sources(records: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per spec: what it has, may use, should give and will give.

    Columns: skey, name, target_records, max_repeats, available (distinct ids),
    total (T, the size of the mix: all distinct ids of active sources), weight (W),
    and planned (copies, a whole number).
    Sources are matched by letters and digits in lower case; specs with a target of
    0 or null are switched off (planned 0); null ids don't count.
    """
    counts = (
        records.where(F.col("id").isNotNull())
        .select(name_key(F.col("source")).alias("skey"), "id")
        .groupBy("skey")
        .agg(F.countDistinct("id").alias("available"))
    )
    on = F.coalesce(F.col("target_records"), F.lit(0)) > 0
    s = (
        F.broadcast(specs.select(name_key(F.col("name")).alias("skey"), "name", F.coalesce("target_records", F.lit(0)).alias("target_records"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats")))
        .join(counts, "skey", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
    )
    total = s.where(on).agg(F.sum("available").alias("total"), F.sum("target_records").alias("weight"))
    s = s.join(F.broadcast(total), F.lit(True), "left")  # one row
    cap = F.col("available") * F.col("max_repeats")
    want = F.floor((F.lit(2) * F.col("total") * F.col("target_records") + F.col("weight")) / (F.lit(2) * F.col("weight"))).cast("bigint")
    return s.select(
        "skey", "name", "target_records", "max_repeats", "available", "total", "weight",
        F.when(on, F.least(want, cap)).otherwise(F.lit(0)).cast("bigint").alias("planned"),
    )


def mix(records: DataFrame, plan: DataFrame, seed: int = 42, leaf_rows: int = 20_000, fan_in: int = 64) -> DataFrame:
    """(skey, id, copies ≥ 1): the copies of each record in the mix.

    Each of a source's records gets the whole part of planned/available copies, and
    the rest by pivotal rounding; the copies of a source sum to `planned`.  The same
    seed gives the same mix on any cluster.  `plan` has a row per spec; its largest
    number of leaves is read to the driver to know the depth of the tree.
    """
    use = plan.where(F.col("planned") > 0).select(
        "skey",
        F.expr("cast(planned div available as int)").alias("whole"),
        (F.col("planned") % F.col("available")).alias("p"),
        F.col("available").alias("unit"),
        F.ceil(F.col("available") / leaf_rows).cast("int").alias("leaves"),
    )
    base = (
        records.where(F.col("id").isNotNull())
        .select(name_key(F.col("source")).alias("skey"), "id")
        .join(F.broadcast(use), "skey")
        .distinct()
        .withColumn("h", F.xxhash64(F.lit(seed), "id"))
    )
    leaves = base.withColumn("leaf", F.pmod("h", F.col("leaves")).cast("int"))
    out = leaves.select("skey", "leaf", "id", "h", "p", "unit").groupBy("skey", "leaf").applyInPandas(_leaf(seed), ROUNDED)
    whole = use.select("skey", "whole")
    level = cut_lineage(out)
    most = plan.agg(F.max(F.ceil(F.col("available") / leaf_rows))).first()[0] or 1
    settled = [level.where(F.col("rest").isNull()).select("skey", "id", "copy")]
    for k in range(max(1, math.ceil(math.log(max(2, most), fan_in)))):
        up = level.where(F.col("rest").isNotNull()).select("skey", F.floor(F.col("leaf") / fan_in).cast("int").alias("leaf"), "id", F.xxhash64(F.lit(seed + k + 1), "id").alias("h"), F.col("rest").alias("p"), "unit")
        level = up.groupBy("skey", "leaf").applyInPandas(_leaf(seed + k + 1), ROUNDED)
        settled.append(level.where(F.col("rest").isNull()).select("skey", "id", "copy"))
    # The masses of a source sum to whole units, so its root has nothing left: no row remains behind the last level.
    parts = settled[0]
    for s in settled[1:]:
        parts = parts.unionByName(s)
    return (
        parts.join(F.broadcast(whole), "skey")
        .select("skey", "id", (F.col("whole") + F.col("copy")).cast("int").alias("copies"))
        .where(F.col("copies") > 0)
    )


def mix_report(records: DataFrame, specs: DataFrame, **kw) -> DataFrame:
    """One row per spec with the shares asked for and reached.

    Columns: source, target_records, max_repeats, available, planned, copies,
    used (records used at all), most (copies of the most repeated record),
    target_share, share (of the mix; null when the mix is empty) and short: the source's
    records, each used as often as allowed in the mix, stay under its share of it.
    """
    plan = cut_lineage(plan_sources(records, specs))
    got = mix(records, plan, **kw).groupBy("skey").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("used"), F.max("copies").alias("most"))
    r = plan.join(F.broadcast(got), "skey", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("copies", "used", "most")})
    r = r.join(F.broadcast(r.agg(F.sum("copies").alias("all_copies"))), F.lit(True), "left")
    # A source is short if the mix took all it may give, and that is under its share of the mix's size.
    full = F.col("copies") == F.col("available") * F.col("max_repeats")
    short = (F.col("target_records") > 0) & full & (F.col("copies") * F.col("weight") < F.col("total") * F.col("target_records"))
    return r.select(
        F.col("name").alias("source"), "target_records", "max_repeats", "available", "planned", "copies", "used", "most",
        F.when(F.col("weight") > 0, F.col("target_records") / F.col("weight")).alias("target_share"),
        F.when(F.col("all_copies") > 0, F.col("copies") / F.col("all_copies")).alias("share"),
        short.alias("short"),
    )

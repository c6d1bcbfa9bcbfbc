"""Packing of token records: spans, sampling weights, fixed-length windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.dedup import running_total
from corpusloom.schema import IGNORE_INDEX


def spans(df: DataFrame, length: str, order: list[str]) -> DataFrame:
    """Add `start` and `end` (exclusive) of each record in the packed vector."""
    return running_total(df, length, order, "end").withColumn("start", F.col("end") - F.col(length))


def trainable(mask: Column) -> Column:
    """Sampling weight: trained targets at the places behind the first."""
    return F.size(F.filter(F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0))), lambda x: x)).cast("bigint")


def cumulative_weights(df: DataFrame, weight: str, order: list[str]) -> DataFrame:
    """Add `lo` and `hi` of each record's share of the draws; records without weight have lo = hi."""
    return running_total(df, weight, order, "hi").withColumn("lo", F.col("hi") - F.col(weight))


def draw_lookup(draws: DataFrame, draw: str, table: DataFrame, block: int = 65_536) -> DataFrame:
    """Join each draw to the record with lo ≤ draw < hi.

    Both sides are cut into blocks of the number line, so the range join is an equi
    join on the block; a record is copied to the blocks that it spans.
    """
    t = table.where("hi > lo").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    d = draws.withColumn("_b", F.floor(F.col(draw) / block))
    return d.join(t, "_b").where((F.col(draw) >= F.col("lo")) & (F.col(draw) < F.col("hi"))).drop("_b")


def window_xy(tokens: Column, mask: Column, start: Column, block: int, pad: int = 0) -> tuple[Column, Column]:
    """Inputs and targets of `block` places from `start`: targets are the next tokens, ignored where untrained, both padded right."""
    x = F.slice(tokens, start + 1, F.least(F.lit(block), F.greatest(F.size(tokens) - start - 1, F.lit(0))))
    y = F.slice(tokens, start + 2, F.size(x))
    m = F.slice(mask, start + 2, F.size(x))
    y = F.zip_with(y, m, lambda t, on: F.when(on, t).otherwise(IGNORE_INDEX))
    fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.lit(block) - F.size(a)))
    return fill(x, pad), fill(y, IGNORE_INDEX)


def draw(seed: int, c: Column | str, below: Column) -> Column:
    """A whole number in 0..below-1 fixed by a seed and a value, by MD5, so that other engines can repeat it."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))), 1, 15)
    return F.pmod(F.conv(h, 16, 10).cast("bigint"), below)


def valid_starts(mask: Column, free: Column, block: int) -> Column:
    """Merged, sorted runs (lo, n) of the window starts 0..free whose `block` targets hold a trained one."""
    runs = F.filter(supervised_chunks(mask), lambda r: r["end"] > 1)  # place 0 is never a target
    cut = F.transform(runs, lambda r: F.struct(F.greatest(F.greatest(r["start"], F.lit(1)) - block, F.lit(0)).alias("lo"), F.least(r["end"] - 2, free).alias("hi")))

    def step(acc: Column, r: Column) -> Column:
        lo = F.greatest(r["lo"], acc["next"])
        fresh = r["hi"] >= lo
        return F.struct(
            F.when(fresh, r["hi"] + 1).otherwise(acc["next"]).cast("int").alias("next"),
            F.when(fresh, F.concat(acc["out"], F.array(F.struct(lo.cast("int").alias("lo"), (r["hi"] - lo + 1).cast("int").alias("n"))))).otherwise(acc["out"]).alias("out"),
        )

    init = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<lo:int,n:int>>").alias("out"))
    return F.aggregate(cut, init, step, lambda a: a["out"])


def pick_start(runs: Column, k: Column) -> Column:
    """The k-th start (from 0) of runs (lo, n)."""
    init = F.struct(k.cast("int").alias("left"), F.lit(-1).alias("at"))

    def step(acc: Column, r: Column) -> Column:
        hit = (acc["at"] < 0) & (acc["left"] < r["n"])
        return F.struct((acc["left"] - F.when(acc["at"] < 0, r["n"]).otherwise(0)).cast("int").alias("left"), F.when(hit, r["lo"] + acc["left"]).otherwise(acc["at"]).cast("int").alias("at"))

    return F.aggregate(runs, init, step, lambda a: a["at"])


def sample_windows(records: DataFrame, n: int, block: int, seed: int, order: list[str], pad: int = 0) -> DataFrame:
    """(draw_id, …, start, x, y): `n` windows drawn by weight from rows with `tokens` and `mask`.

    A record is drawn by its trained targets and a start evenly among those whose
    window holds one, which is what drawing until a target is met comes to.  Draws
    are hashes of the seed, so a run can be repeated on any cluster.
    """
    w = cumulative_weights(records.withColumn("weight", trainable(F.col("mask"))), "weight", order)
    total = w.agg(F.max("hi")).first()[0] or 0
    if total == 0:
        raise ValueError("no record has a trainable target")
    draws = records.sparkSession.range(n).select(F.col("id").alias("draw_id"), draw(seed, "id", F.lit(total)).alias("draw"))
    d = draw_lookup(draws, "draw", w)
    free = F.greatest(F.size("tokens") - block - 1, F.lit(0))
    d = d.withColumn("_runs", valid_starts(F.col("mask"), free, block))
    many = F.aggregate("_runs", F.lit(0), lambda a, r: a + r["n"])
    d = d.withColumn("start", pick_start(F.col("_runs"), draw(seed + 1, "draw_id", many)))
    x, y = window_xy(F.col("tokens"), F.col("mask"), F.col("start"), block, pad)
    return d.withColumn("x", x).withColumn("y", y).drop("_runs", "lo", "hi", "weight")


def supervised_chunks(mask: Column) -> Column:
    """Runs of trained places as (start, end) structs, end exclusive."""
    edges = F.transform(mask, lambda m, i: F.when(m & ~F.coalesce(F.get(mask, i - 1) & (i > 0), F.lit(False)), i))
    ends = F.transform(mask, lambda m, i: F.when(m & ~F.coalesce(F.get(mask, i + 1), F.lit(False)), i + 1))
    a, b = F.filter(edges, lambda x: x.isNotNull()), F.filter(ends, lambda x: x.isNotNull())
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("start"), y.alias("end")))


def batch_counts(df: DataFrame, y: str = "y", x: str = "x", pad: int = 0) -> DataFrame:
    """One row: targets, ignored and padded places of a batch of windows."""
    e = df.select(F.explode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("p"))
    return e.agg(F.count_if(F.col("p.y") != IGNORE_INDEX).alias("targets"), F.count_if(F.col("p.y") == IGNORE_INDEX).alias("ignored"), F.count_if(F.col("p.x") == pad).alias("padding"))


def limit_chars(df: DataFrame, text: str, order: list[str], budget: int) -> DataFrame:
    """Records in order up to a budget of characters; the first one above it is cut to what is left and ends the list.

    Adds `kept` (the text) and `cut`.
    """
    r = running_total(df.withColumn("_n", F.length(text)), "_n", order, "_end").withColumn("_begin", F.col("_end") - F.col("_n"))
    first = r.where(F.col("_end") > budget).agg(F.min(F.struct(*order)).alias("_stop"))
    j = r.join(F.broadcast(first), F.lit(True), "left")
    ok = F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))
    boundary = (F.struct(*order) == F.col("_stop")) & (F.col("_begin") < budget)
    return (
        j.where(ok | boundary)
        .withColumn("kept", F.when(ok, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.lit(budget) - F.col("_begin").cast("int"))))
        .withColumn("cut", ~ok).drop("_n", "_end", "_begin", "_stop")
    )

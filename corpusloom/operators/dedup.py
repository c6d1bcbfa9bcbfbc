"""First-valid de-duplication, quotas, source folds and their counters.

A window is accepted if it is the first valid one of its key; invalid ones before
it are skipped, later ones are duplicates.  Order is a column expression, never
the order of partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.skew import cut_lineage


def first_valid(df: DataFrame, key: str, order: list[str], valid: str = "valid", status: str = "status") -> DataFrame:
    """Add `status`: accepted, duplicate or skipped.

    The first valid row of a key, by `order`, is accepted; rows after it are
    duplicates; rows before it, or of keys without valid rows, are skipped.  The
    firsts are aggregated partially before the shuffle and joined back, so a hot key
    costs a few rows; rows of a null key are never duplicates of each other.
    """
    o = F.struct(*order)
    firsts = df.where(F.col(key).isNotNull() & F.col(valid)).groupBy(key).agg(F.min(o).alias("_first"))
    j = df.join(firsts, key, "left")
    s = F.when(F.col(key).isNull(), F.when(F.col(valid), "accepted").otherwise("skipped")).when(o == F.col("_first"), "accepted").when(F.col("_first").isNull() | (o < F.col("_first")), "skipped").otherwise("duplicate")
    return j.withColumn(status, s).drop("_first")


def first_occurrence(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order` (which must be unique); null keys count as one key."""
    cols = [c for c in df.columns if c not in order]
    best = df.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order, *cols)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def in_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in range partitions by `keys`, written once, with their partition in `_p`."""
    return cut_lineage(df.repartitionByRange(*[F.col(c) for c in keys]).withColumn("_p", F.spark_partition_id()))


def rank_per_key(df: DataFrame, key: str, order: list[str], rank: str = "rank") -> DataFrame:
    """Add each row's rank, from 1, within its key by `order`; null keys are one key.

    Rows lie in range partitions of (key, order), so however hot a key is, no task
    holds more than its range.  Only the first key of a partition can have begun in an
    earlier one; its offset is a table of one row per partition, which is broadcast.
    """
    s = in_ranges(df, [key, *order])
    n = s.groupBy("_p", F.struct(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    first = n.groupBy("_p").agg(F.min("_k").alias("_first")).select(F.col("_p").alias("_q"), "_first")
    met = n.join(F.broadcast(first), F.col("_k") == F.col("_first")).where("_p < _q")
    offset = met.groupBy(F.col("_q").alias("_p")).agg(F.sum("_c").alias("_off"))
    begin = first.withColumnRenamed("_q", "_p").join(offset, "_p", "left")  # one row per partition
    j = s.withColumn("_i", F.row_number().over(Window.partitionBy("_p", key).orderBy(*order))).join(F.broadcast(begin), "_p")
    off = F.when(F.struct(key) == F.col("_first"), F.coalesce("_off", F.lit(0))).otherwise(0)
    return j.withColumn(rank, F.col("_i") + off).drop("_p", "_i", "_first", "_off")


def source_quota(accepted: DataFrame, source: str, order: list[str], quota: int | Column, rank: str = "rank") -> DataFrame:
    """At most `quota` accepted rows of each source, in order, with their rank.  `quota` may be a column."""
    return rank_per_key(accepted, source, order, rank).where(F.col(rank) <= quota).withColumn(rank, F.col(rank).cast("int"))


def counters(df: DataFrame, by: list[str], status: str = "status", reason: str | None = "reason", sums: dict[str, str] | None = None, dialog: str | None = None) -> DataFrame:
    """Counts of judged windows per group.

    `candidates` (all windows), `written`, `duplicates`, `skipped`, with `dialog` also
    `scanned` (its distinct values), sums of columns over the written windows under the
    names of `sums`, and the reasons of the skipped as a map `skip_reasons`.  No `by`
    gives the totals.
    """
    aggs = [F.count(F.lit(1)).alias("candidates"), *(F.count_if(F.col(status) == x).alias(n) for x, n in (("accepted", "written"), ("duplicate", "duplicates"), ("skipped", "skipped")))]
    if dialog:
        aggs.insert(0, F.countDistinct(dialog).alias("scanned"))
    aggs += [F.coalesce(F.sum(F.when(F.col(status) == "accepted", F.col(c))), F.lit(0)).alias(n) for n, c in (sums or {}).items()]
    out = df.groupBy(*by).agg(*aggs)
    if reason is None:
        return out
    hist = df.where(F.col(status) == "skipped").groupBy(*by, reason).count().groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(reason, F.lit("")).alias("k"), "count")))).alias("skip_reasons"))
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return out.alias("a").join(hist.alias("b"), cond, "left").select("a.*", "b.skip_reasons") if by else out.crossJoin(hist)


def skip_reasons(df: DataFrame, by: list[str], status: str = "status", reason: str = "reason") -> DataFrame:
    """(by…, reason, n): how often each reason kept a window that no accepted one came before."""
    return df.where(F.col(status) == "skipped").groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def fold_sources(sources: Iterable[tuple[str, DataFrame, int]], key: str, order: list[str], valid: str = "valid") -> DataFrame:
    """Accepted rows of several sources taken one after the other.

    A key accepted from an earlier source is a duplicate in a later one; rows behind a
    source's quota aren't accepted and so block nothing.  The loop runs over the
    configured sources; each step's keys are cut to the checkpoint folder.
    """
    seen: DataFrame | None = None
    out: DataFrame | None = None
    for name, df, quota in sources:
        if quota <= 0:
            continue
        own = df.withColumn("source_name", F.lit(name))
        if seen is not None:
            own = own.join(seen, key, "left_anti")
        own = first_valid(own, key, order, valid).where(F.col("status") == "accepted").drop("status")
        own = cut_lineage(source_quota(own, "source_name", order, quota))
        out = own if out is None else out.unionByName(own)
        keys = own.select(key)
        seen = keys if seen is None else seen.unionByName(keys)
    if out is None:
        raise ValueError("no source has a quota")
    return out


def number(df: DataFrame, pattern: str, order: list[str], per: str | None = None, col: str = "id", start: int = 0, limit: int | None = None) -> DataFrame:
    """Sequential ids like 'x-%07d' in order, over all rows or within each `per`; `limit` keeps the first rows of the whole order.

    Numbers come from a range partitioning and the counts of its partitions, so no
    task holds more than its range.
    """
    if per:
        ranked = rank_per_key(df, per, order, "_n").withColumn("_n", F.col("_n") - 1)
    else:
        ranked = running_total(df.withColumn("_one", F.lit(1)), "_one", order, "_n").withColumn("_n", F.col("_n") - 1).drop("_one")
    if limit is not None:
        ranked = ranked.where(F.col("_n") < limit)
    return ranked.withColumn(col, F.format_string(pattern, F.col("_n") + F.lit(start))).drop("_n")


def running_total(df: DataFrame, value: str, order: list[str], out: str = "total") -> DataFrame:
    """Inclusive running sum in a total order, from range partitions and their sums (no single-task window)."""
    spread = in_ranges(df, order)
    s = spread.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = s.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))
    own = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("_o", own).join(F.broadcast(before), "_p").withColumn(out, F.col("_o") + F.col("_b")).drop("_p", "_o", "_b")


def seeded_order(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in a shuffled order fixed by the seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def full_batches(df: DataFrame, size: int, order: list[str], col: str = "batch") -> DataFrame:
    """Rows in batches of exactly `size`; the remainder is dropped."""
    n = df.count()
    r = running_total(df.withColumn("_one", F.lit(1)), "_one", order, "_n")
    return r.withColumn(col, F.floor((F.col("_n") - 1) / size)).where(F.col("_n") <= n // size * size).drop("_n", "_one")

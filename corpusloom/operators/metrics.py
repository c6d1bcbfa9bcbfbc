"""Aggregates over predictions, embeddings and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import let, log_softmax, smoothed_nll
from corpusloom.operators.dedup import in_ranges
from corpusloom.operators.skew import cut_lineage, join_unique, plan_bytes


def accuracy(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Share of equal, non-null pairs in per cent; null without any."""
    ok = F.when(F.col(label).isNotNull() & F.col(predicted).isNotNull(), (F.col(label) == F.col(predicted)).cast("int"))
    return df.groupBy(*(by or [])).agg(F.count(ok).alias("n"), (F.avg(ok) * 100).alias("accuracy"))


def errors(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean and summed absolute error and mean squared error over non-null pairs."""
    d = F.col(y) - F.col(p)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.sum(F.abs(d)).alias("sae"), F.avg(d * d).alias("mse"))


def masked_loss(df: DataFrame, logits: str, gold: str, ignore: int = -100, smoothing: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Means over the places whose target isn't ignored; 0 without any.

    `loss` (cross entropy), `smoothed` (with label smoothing), `dft` (cross entropy
    weighted by the gold probability), `gold_prob`, and their number `valid`.
    """
    ok = F.col(gold) != ignore
    lp = F.get(log_softmax(F.col(logits)), F.greatest(F.col(gold), F.lit(0)))
    d = df.select(*(by or []), ok.alias("_ok"), lp.alias("_lp"), smoothed_nll(F.col(logits), F.greatest(F.col(gold), F.lit(0)), max(0.0, min(1.0, smoothing))).alias("_s"))
    mean = lambda c: F.coalesce(F.sum(F.when(F.col("_ok"), c)) / F.greatest(F.count_if("_ok"), F.lit(1)), F.lit(0.0))
    return d.groupBy(*(by or [])).agg(
        mean(-F.col("_lp")).alias("loss"), mean(F.col("_s")).alias("smoothed"), mean(-F.col("_lp") * F.exp("_lp")).alias("dft"), mean(F.exp("_lp")).alias("gold_prob"), F.count_if("_ok").alias("valid")
    )


# Names of the loss objectives.
OBJECTIVES = {"ce": "ce", "sft": "ce", "nll": "ce", "cross_entropy": "ce", "ce_dft": "ce_dft", "dft_mix": "ce_dft", "mixed_dft": "ce_dft", "dft": "dft"}


def objective_loss(objective: str, smoothed: Column, dft: Column, alpha: Column | float = 1.0) -> Column:
    """The loss trained on: smoothed cross entropy, the weighted one, or their mix by `alpha`; other names are an error."""
    kind = OBJECTIVES.get(objective.lower())
    if kind is None:
        raise ValueError(f"unknown loss objective {objective!r}")
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return {"ce": smoothed, "dft": dft, "ce_dft": (1 - a) * smoothed + a * dft}[kind]


def mean_metrics(batches: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: each metric's mean over the batches, every batch counting once, and their number."""
    return batches.agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("batches"))


def global_norm(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def clip_factor(norm: Column, limit: float) -> Column:
    return F.least(F.lit(1.0), F.lit(limit) / F.greatest(norm, F.lit(1e-12)))


def scatter_add(df: DataFrame, index: str, value: str) -> DataFrame:
    """(index, total): sums by index."""
    return df.groupBy(index).agg(F.sum(value).alias("total"))


def gather_embeddings(tokens: DataFrame, key: str, ids: str, vectors: DataFrame, vec_id: str, vector: str, scale: float = 1.0, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(key, pos, vector): the scaled vector of every id; unknown and null ids have none.

    `vectors` has one row per id.  Ids of texts are skewed: a table estimated under
    `broadcast_bytes` is broadcast; a larger one is joined by `join_unique`, which
    broadcasts the hot ids only and for that counts the ids once.
    """
    t = tokens.select(key, F.posexplode(ids).alias("pos", vec_id)).where(F.col(vec_id).isNotNull())
    v = vectors.select(vec_id, F.transform(vector, lambda x: x * F.lit(scale)).alias("vector"))
    if plan_bytes(vectors) <= broadcast_bytes:
        return t.join(F.broadcast(v), vec_id).select(key, "pos", "vector")
    n = t.groupBy(vec_id).agg(F.count(F.lit(1)).alias("_n"))
    right = cut_lineage(v.join(n, vec_id))
    total = right.agg(F.sum("_n")).first()[0] or 0
    return join_unique(t, right, [vec_id], "_n", total).where(F.col("vector").isNotNull()).select(key, "pos", "vector")


def draw_index(probs: Column, u: Column) -> Column:
    """Place of the first cumulative probability above u; the last one if rounding leaves none."""
    init = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))

    def step(acc: Column, p: Column) -> Column:
        total = acc["sum"] + p
        return F.struct(total.alias("sum"), (acc["below"] + F.when(total <= u, 1).otherwise(0)).cast("int").alias("below"))

    return let(probs, lambda v: F.least(F.aggregate(v, init, step)["below"], F.size(v) - 1))


def ema(values: Column, keep: float = 0.9) -> Column:
    """Exponential moving average along an ordered array, begun with its first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.coalesce(a * keep + x * (1 - keep), x))


def ema_by(df: DataFrame, key: str, order: list[str], value: str, keep: float = 0.9, out: str = "ema") -> DataFrame:
    """(key, out): each key's exponential moving average along `order`, begun with its first value; null values don't count.

    A row weighs (1 - keep) · keep^later, the first one keep^later.  Rows lie in range
    partitions; each gives one partial sum a key, which the rows of later partitions
    damp, so no task holds all rows of a key.
    """
    s = in_ranges(df.where(F.col(value).isNotNull()).select(key, *[c for c in order if c != key], value), [key, *order])
    own = Window.partitionBy("_p", key)
    ranked = s.withColumn("_i", F.row_number().over(own.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(own))
    damped = F.col(value) * F.pow(F.lit(keep), F.col("_n") - F.col("_i"))
    first = F.max(F.when(F.col("_i") == 1, damped))
    parts = ranked.groupBy(key, "_p").agg(F.sum(damped).alias("_s"), first.alias("_f"), F.max("_n").alias("_n"))  # one row per key and partition it meets
    later = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.row_number().over(Window.partitionBy(key).orderBy("_p")) == 1
    p = parts.select(key, "_s", "_f", later.alias("_later"), begin.alias("_begin"))
    share = F.col("_s") * (1 - keep) + F.when(F.col("_begin"), F.col("_f") * keep).otherwise(0.0)
    return p.groupBy(key).agg(F.sum(share * F.pow(F.lit(keep), F.col("_later"))).alias(out))

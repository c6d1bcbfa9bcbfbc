"""Numeric expressions: learning-rate schedules, soft-max and losses over arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it (lambdas aren't searched for common parts)."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def warmup_cosine(step: Column, base: float, warmup: int, total: int, floor: float = 0.0) -> Column:
    """Linear warm-up to `base`, then a cosine down to `floor` at `total`."""
    up = F.lit(base) * step / F.lit(max(1, warmup))
    x = F.least(F.greatest((step - warmup) / F.lit(max(1, total - warmup)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, up).otherwise(F.lit(floor) + F.lit(base - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * x)))


def inverse_sqrt(step: Column, dim: int, warmup: int) -> Column:
    """dim^-0.5 · min(step^-0.5, step · warmup^-1.5); steps start at 1."""
    s = F.greatest(step, F.lit(1)).cast("double")
    return F.lit(dim**-0.5) * F.least(F.pow(s, F.lit(-0.5)), s * F.lit(warmup**-1.5))


def step_decay(step: Column, base: float, every: int, factor: float) -> Column:
    return F.lit(base) * F.pow(F.lit(factor), F.floor(step / F.lit(every)).cast("double"))


def ramp(step: Column, start: int, end: int, low: float = 0.0, high: float = 1.0) -> Column:
    """`low` up to `start`, `high` from `end`, linear between."""
    x = F.least(F.greatest((step - start) / F.lit(max(1, end - start)), F.lit(0.0)), F.lit(1.0))
    return F.lit(low) + F.lit(high - low) * x


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Soft-max of an array; empty arrays stay empty."""
    e = let(logits, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / F.lit(temperature)))))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(v, lambda x: x / total)))


def log_softmax(logits: Column) -> Column:
    def body(v: Column) -> Column:
        def shifted(top: Column) -> Column:
            return let(F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top, lambda norm: F.transform(v, lambda x: x - norm))

        return let(F.array_max(v), shifted)

    return let(logits, body)


def smoothed_nll(logits: Column, gold: Column, eps: float) -> Column:
    """(1-eps) · -log p[gold] + eps · mean(-log p)."""
    return let(log_softmax(logits), lambda lp: -F.lit(1 - eps) * F.get(lp, gold) - F.lit(eps) * F.aggregate(lp, F.lit(0.0), lambda a, x: a + x) / F.size(lp))


def top_k_mask(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become -infinity; ties with it stay."""

    def body(v: Column) -> Column:
        kth = F.get(F.sort_array(v, asc=False), F.least(F.lit(k), F.size(v)) - 1)
        return let(kth, lambda least: F.transform(v, lambda x: F.when(x >= least, x).otherwise(F.lit(float("-inf")))))

    return let(logits, body)

"""Filling containers of fixed capacity with documents measured in tokens.

The global histogram of item lengths has at most capacity+1 classes whatever the
size of the corpus.  Dynamic programming over it chooses length buckets that
minimise padding.  Token-budget batches then form inside each bucket: a batch takes
items of its bucket, the longest first, while they fit.  As an option, what stays
free is topped up from the buckets below, which goes beyond buckets: it fills nearly
everything, but a container then holds short and long items.  All of that happens on
counts; the items only learn their rank within their length, in shards, and from it
their container.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import TOKENIZERS, byte_encoder
from corpusloom.operators.skew import cut_lineage, spread


def count_udf(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """Number of tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = byte_encoder(folder, name)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], index=texts.index, dtype="int64")

    return count


def length_buckets(hist: dict[int, int], k: int) -> list[int]:
    """Upper bounds of at most `k` buckets over the lengths of a histogram with the least total padding.

    Padding is the sum over items of (upper bound of the bucket - length).
    """
    lens = np.array(sorted(hist))
    if not len(lens):
        return []
    n = np.array([hist[x] for x in lens.tolist()], dtype=np.float64)
    cn, cl = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lens)])
    m, k = len(lens), min(k, len(lens))
    # cost[i, j]: lengths i..j in one bucket
    best = lens * cn[1:] - cl[1:]
    back = [np.zeros(m, dtype=int)]
    for _ in range(1, k):
        new, arg = best.copy(), np.full(m, -1)
        for j in range(1, m):
            c = best[:j] + lens[j] * (cn[j + 1] - cn[1 : j + 1]) - (cl[j + 1] - cl[1 : j + 1])
            i = int(c.argmin())
            if c[i] < new[j]:
                new[j], arg[j] = c[i], i
        best = new
        back.append(arg)
    bounds, j = [], m - 1
    for arg in reversed(back[1:]):
        if arg[j] >= 0:
            bounds.append(int(lens[j]))
            j = arg[j]
    return sorted({*bounds, int(lens[j])})


def batch_shapes(hist: dict[int, int], bounds: list[int], capacity: int, top_up: bool = True) -> list[tuple[int, dict[int, int]]]:
    """Batches as (how many, {length: items of it in each}); together they use up the histogram.

    A batch holds items of one bucket, with `top_up` also of lower ones.  Each shape
    exhausts at least one length, so there are no more shapes than lengths.
    """
    left = {x: c for x, c in hist.items() if c > 0 and x > 0}
    order = sorted(left)
    shapes = []
    while order:
        free, shape = capacity, {}
        bucket_of = bisect_right(bounds, order[-1] - 1)
        low = bounds[bucket_of - 1] if bucket_of > 0 else 0
        for inside in (True, False) if top_up else (True,):  # first the bucket itself, then the ones below
            i = bisect_right(order, free) - 1
            while i >= 0 and free > 0:
                x = order[i]
                if inside and x <= low:
                    break
                take = min(free // x, left[x] - shape.get(x, 0))
                if take > 0:
                    shape[x] = shape.get(x, 0) + take
                    free -= take * x
                i = min(i - 1, bisect_right(order, free) - 1)
        times = min(left[x] // c for x, c in shape.items())
        shapes.append((times, shape))
        for x, c in shape.items():
            left[x] -= times * c
            if not left[x]:
                del left[x]
                order.remove(x)
    return shapes


def split_oversize(lengths: DataFrame, capacity: int) -> DataFrame:
    """(…, n) → one row per item: `part`, `start_token`, `n_tokens`; only n > capacity gives several."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    return (
        lengths.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("start_token", F.col("part").cast("bigint") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity), F.col("n") - F.col("start_token")).cast("int"))
        .drop("n")
    )


def place_table(hist: dict[int, int], ranges: list[tuple[int, int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(length, block size) and (length, block, *range) of the ranges of ranks (length, lo, hi, base, each, bucket).

    The ranks of a length are cut into as many blocks as it has ranges, so a rank's
    block meets about two of them, and the range is found by an equal join.
    """
    many: dict[int, int] = {}
    for r in ranges:
        many[r[0]] = many.get(r[0], 0) + 1
    size = {x: max(1, -(-hist.get(x, 1) // m)) for x, m in many.items()}
    return list(size.items()), [(x, b, lo, *rest) for x, lo, *rest in ranges for b in range(lo // size[x], (rest[0] - 1) // size[x] + 1)]


def fill_containers(items: DataFrame, key: list[str], capacity: int = 2048, buckets: int = 3, top_up: bool = False, shard_rows: int = 100_000) -> DataFrame:
    """Add `bucket` (upper bound of its length bucket) and `container` to rows with `n_tokens` ≤ capacity.

    The number of containers follows from the histogram alone.  Items without
    tokens go to container 0.  Equal rows are separate items.  Only counts by length
    (≤ capacity+1 rows) reach the driver; the broadcast tables have at most a few
    rows per length and shard.
    """
    items = cut_lineage(items)
    hist = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}
    bounds = length_buckets({x: c for x, c in hist.items() if x > 0}, buckets)
    rows, base, used = [(0, 0, max(1, hist.get(0, 0)), 0, max(1, hist.get(0, 0)), 0)], 0, {}
    for times, shape in batch_shapes(hist, bounds, capacity, top_up):
        for x, c in shape.items():
            at = used.get(x, 0)
            rows.append((x, at, at + times * c, base, c, bounds[bisect_right(bounds, x - 1)]))
            used[x] = at + times * c
        base += times
    sizes, blocks = place_table(hist, rows)
    size = F.broadcast(items.sparkSession.createDataFrame(sizes, "n_tokens int, _size bigint"))
    places = F.broadcast(items.sparkSession.createDataFrame(blocks, "n_tokens int, _block bigint, lo bigint, hi bigint, base bigint, each bigint, bucket int"))
    shards = max(1, -(-sum(hist.values()) // shard_rows))
    sharded = items.withColumn("_shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    counts = sharded.groupBy("n_tokens", "_shard").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("n_tokens", "_shard", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("_shard")) - F.col("c")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("n_tokens", "_shard").orderBy(*key))
    ranked = sharded.withColumn("_r", inner).join(before, ["n_tokens", "_shard"]).withColumn("_r", F.col("_r") - 1 + F.col("_before"))
    placed = ranked.join(size, "n_tokens").withColumn("_block", F.expr("_r div _size")).join(places, ["n_tokens", "_block"])
    hit = placed.where((F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi")))
    return hit.select(*items.columns, "bucket", (F.col("base") + F.floor((F.col("_r") - F.col("lo")) / F.col("each"))).cast("bigint").alias("container"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, buckets: int = 3, top_up: bool = False, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id_col, part, start_token, n_tokens, bucket, container) of every document.

    A document up to the capacity is one item; a longer one is split into full
    pieces and a rest.  Null and empty texts are items of 0 tokens in container 0.
    """
    n = spread(docs.select(id_col, text_col)).select(F.col(id_col), count_udf(folder, name)(F.col(text_col)).alias("n"))
    return fill_containers(split_oversize(n, capacity), [id_col, "part"], capacity, buckets, top_up)


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: documents, items, tokens, containers, unused tokens and the share filled."""
    per = packed.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("items"))
    s = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.max("t").alias("fullest"))
    return s.select("containers", "items", "tokens", "fullest", (F.col("containers") * capacity - F.col("tokens")).alias("unused"), (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"))

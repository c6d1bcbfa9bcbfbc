"""Paths of a message tree from its leaves to its roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dialog import segment
from corpusloom.operators.quality import message_ok
from corpusloom.operators.skew import cut_lineage


def leaf_paths(nodes: DataFrame, id_col: str, parent_col: str, max_rounds: int = 40) -> DataFrame:
    """(leaf, steps, id): all ancestors of each leaf, `steps` above it; the leaf itself has 0.

    An unknown or null parent makes a root.  Leaves are ids that are nobody's parent.
    Paths double in each round, so a depth of d takes log2(d) joins, every one on an
    id; a round that adds nothing ends the loop, and a path never visits an id twice.
    """
    n = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up")).where("id is not null")
    known = n.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    edges = cut_lineage(n.join(known.distinct(), "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up")).distinct())
    parents = edges.where("up is not null").select(F.col("up").alias("id")).distinct()
    reach = cut_lineage(edges.join(parents, "id", "left_anti").select(F.col("id").alias("leaf"), F.lit(0).cast("bigint").alias("steps"), "id"))
    jump, step = edges.where("up is not null"), 1
    for _ in range(max_rounds):
        more = reach.join(jump, "id").select("leaf", (F.col("steps") + step).alias("steps"), F.col("up").alias("id")).where(F.col("leaf") != F.col("id"))
        fresh = cut_lineage(more.groupBy("leaf", "id").agg(F.min("steps").alias("steps")).join(reach.select("leaf", "id"), ["leaf", "id"], "left_anti").select("leaf", "steps", "id"))
        if fresh.isEmpty():  # the end of the longest path, or only cycles go on
            break
        reach = cut_lineage(reach.unionByName(fresh))
        nxt = jump.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        jump = cut_lineage(jump.join(nxt, "up").select("id", F.col("up2").alias("up")))
        step *= 2
    return reach


def answer_paths(messages: DataFrame, max_toxicity: float = 0.5) -> DataFrame:
    """(leaf, score, n, segments): root-to-leaf paths of the kept messages that end with an assistant, best score first by (score, -n, leaf).

    The score sums the ranks of the messages whose role is literally 'assistant'; a
    null rank counts 1000.  Neighbours of one role aren't merged here.
    """
    kept = messages.where(message_ok(max_toxicity))
    path = leaf_paths(kept, "message_id", "parent_id")
    said = kept.select(F.col("message_id").alias("id"), "role", X.nfc(F.col("text")).alias("text"), F.coalesce("rank", F.lit(1000)).alias("rank")).dropDuplicates(["id"])
    full = path.join(said, "id").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("k"), "role", "text", "rank"))).alias("p"))
    role = X.normalize_role(F.try_element_at("p", F.lit(-1))["role"])
    score = F.aggregate(F.transform("p", lambda m: F.when(m["role"] == "assistant", m["rank"]).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    s = F.transform("p", lambda m: segment(X.normalize_role(m["role"]), X.normalize_text(m["text"], False)))
    return full.where(role == "assistant").select("leaf", score.alias("score"), F.size("p").alias("n"), s.alias("segments"))


def children(messages: DataFrame) -> DataFrame:
    """(parent_id, children): child ids by rank (null last), then id; an unknown parent counts as null."""
    known = messages.select(F.col("message_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    m = messages.join(known, "parent_id", "left").select(F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), "message_id", F.coalesce("rank", F.lit(1000)).alias("rank"))
    c = m.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_set(F.struct("rank", "message_id"))).alias("c"))
    return c.select("parent_id", F.transform("c", lambda x: x["message_id"]).alias("children"))

"""Token frequencies and vocabularies pruned by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import CJK, nfc, strip
from corpusloom.operators.skew import cut_lineage
from corpusloom.schema import SPECIAL_TOKENS

# Characters that every vocabulary holds.
ASCII_FALLBACK = tuple("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
# Punctuation that every vocabulary holds.
COMMON_PUNCTUATION = tuple(".,!?;:'\"()[]{}<>+-=*/\\|_@#$%^&`~，。！？；：、（）《》【】“”‘’")

ENGLISH = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"
#: Tokens of a source vocabulary that stand for something outside of the text.
MARKER = r"^\[.*\]$"


def token_frequencies(texts: DataFrame, text: str, order: str) -> DataFrame:
    """(kind, token, n, first): CJK characters and English words of composed lower-case texts with their counts.

    `first` is the earliest (order, place), by which equal counts are ranked.  Texts are
    scanned once; counts are aggregated partially before the shuffle.
    """
    t = texts.select(F.col(order).alias("o"), F.lower(nfc(F.coalesce(text, F.lit("")))).alias("t"))
    own = lambda kind, pattern: F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("p"), x.alias("token")))
    both = t.select("o", F.explode(F.concat(own("cjk", CJK), own("word", ENGLISH))).alias("w")).select("o", "w.*")
    return both.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first"))


def top_tokens(freq: DataFrame, k: int) -> DataFrame:
    """(token, n, rank): the k most frequent tokens of all kinds; ties by first occurrence."""
    order = [F.desc("n"), "first.o", "first.p", "kind"]
    return freq.orderBy(*order).limit(k).select("token", "n", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def categories(token: Column) -> Column:
    """Category of a source token: cjk, word, piece, cjk_word, or null."""
    ascii_piece = r"^[A-Za-z0-9']+$"
    return (
        F.when(token.rlike(rf"^{CJK}$"), "cjk").when(token.rlike(r"^##[A-Za-z0-9']+$"), "piece")
        .when(token.rlike(ascii_piece) & token.rlike("[A-Za-z]"), "word").when((F.length(token) > 1) & token.rlike(CJK) & ~token.rlike(MARKER), "cjk_word")
    )


def prune(source: DataFrame, size: int = 4096, caps: dict[str, int] | None = None, extra: tuple[str, ...] = (), freq: DataFrame | None = None) -> DataFrame:
    """(id, token): a compact vocabulary from a source vocabulary (token, ord).

    Specials, `extra`, ASCII and punctuation first, then each category up to its cap
    in the source's order — or, with `freq`, CJK characters and words of the source in
    the order of their counts — and the rest of the source up to `size`.  ASCII tokens
    and pieces are lowered.  Only tokens that are new count against a cap.  Every
    category is cut by a distributed top-k, so what meets in one task is bounded by
    `size` and the caps.
    """
    caps = {"cjk": 1000, "word": 2000, "piece": 1000, "cjk_word": 0} | (caps or {})
    spark = source.sparkSession
    fixed = list(dict.fromkeys([*SPECIAL_TOKENS, *extra, *ASCII_FALLBACK, *COMMON_PUNCTUATION]))
    if size < len(fixed):
        raise ValueError(f"size must be at least {len(fixed)}")
    base = spark.createDataFrame(list(enumerate(fixed)), "ord int, token string").select(F.lit(0).alias("stage"), F.col("ord").cast("bigint"), "token")
    low = F.when(F.col("token").rlike(r"^\p{ASCII}*$|^##"), F.lower("token")).otherwise(F.col("token"))
    src = source.where(F.length("token") > 0).groupBy("token").agg(F.min("ord").cast("bigint").alias("ord")).select(low.alias("token"), "ord", categories(F.col("token")).alias("kind"))
    src = src.groupBy("kind", "token").agg(F.min("ord").alias("ord"))
    fresh = cut_lineage(src.join(F.broadcast(base.select("token")), "token", "left_anti"))  # read once for every category
    by_count = freq is not None
    if by_count:
        known = fresh.select("token").distinct()
        counted = cut_lineage(freq.join(known, "token", "left_semi").select("kind", "token", (-F.col("n")).alias("a"), F.col("first.o").alias("b"), F.col("first.p").alias("c")))
    parts = [base]
    for stage, kind in enumerate(("cjk", "word", "piece", "cjk_word"), 1):
        if caps[kind] <= 0:
            continue
        if by_count and kind in ("cjk", "word"):
            own, order = counted.where(F.col("kind") == kind), ["a", "b", "c", "token"]
        else:
            own, order = fresh.where(F.col("kind") == kind), ["ord", "token"]
        best = own.orderBy(*order).limit(caps[kind])
        parts.append(best.select(F.lit(stage).alias("stage"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("ord"), "token"))
    fill = F.col("token").startswith("##") | F.col("token").rlike(CJK) | F.col("token").rlike("^[A-Za-z0-9']+$") | (F.length("token") == 1)
    rest = fresh.where(fill & ~F.col("token").rlike(MARKER) & (strip(F.col("token")) != "")).groupBy("token").agg(F.min("ord").alias("ord"))
    parts.append(rest.orderBy("ord", "token").limit(size).select(F.lit(5).alias("stage"), "ord", "token"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("token").agg(F.min(F.struct("stage", "ord")).alias("at"))
    best = one.orderBy("at.stage", "at.ord", "token").limit(size)
    return best.select((F.row_number().over(Window.orderBy("at.stage", "at.ord", "token")) - 1).alias("id"), "token")

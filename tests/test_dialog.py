from helpers import frame, segs, shape
from pyspark.sql import functions as F

from corpusloom.operators import dialog as D
from corpusloom.functions import text as X

SIX = segs(("u", "u0"), ("a", "a1"), ("u", "u2"), ("a", "a3"), ("u", "u4"), ("a", "a5"))


def test_compact_merges_and_drops(spark):
    rows = [("x", segs(("human", "a"), ("u", " b "), ("gpt", ""), ("a", "c"), ("moderator", "z"), ("s", "s1"), ("s", "s2"))), ("null", None), ("none", [])]
    out = {r["id"]: r["s"] for r in frame(spark, rows).select("id", D.compact(F.col("segments"), clean=X.strip).alias("s")).collect()}
    assert shape(out["x"]) == ["u:a\nb", "a:c*", "s:s1\ns2"]
    assert out["null"] is None and out["none"] == []
    apart = frame(spark, rows[:1]).select(D.compact(F.col("segments"), clean=X.strip, merge_system=False).alias("s")).first()["s"]
    assert shape(apart)[2:] == ["s:s1", "s:s2"]


def test_multi_size_windows(spark):
    w = D.context_windows(frame(spark, [("x", SIX)]), [6, 2, 4, 4, 1]).orderBy("turn", "size").collect()
    assert [(r["turn"], r["size"], r["window"][0]["content"], len(r["window"])) for r in w] == [
        (1, 2, "u0", 2), (1, 4, "u0", 2), (1, 6, "u0", 2), (3, 2, "u2", 2), (3, 4, "u0", 4), (3, 6, "u0", 4), (5, 2, "u4", 2), (5, 4, "u2", 4), (5, 6, "u0", 6),
    ]
    assert all([s["train"] for s in r["window"]] == [False] * (len(r["window"]) - 1) + [True] for r in w)


def test_sliding_start_skips_assistant(spark):
    w = D.context_windows(frame(spark, [("x", SIX[:4])]), [3]).where("turn = 3").first()
    assert shape(w["window"]) == ["u:u2", "a:a3*"]


def test_prefix_single_full(spark):
    f = frame(spark, [("x", segs(("s", "sys"), ("a", "a0"), *[(r[0][0], r[1]) for r in SIX[:4]], ("u", "end"))), ("lonely", segs(("a", "only"))), ("null", None)])
    assert [(r["id"], r["turn"]) for r in D.prefix_windows(f).orderBy("id", "turn").collect()] == [("x", 3), ("x", 5)]
    assert [r["turn"] for r in D.prefix_windows(f, 3).collect()] == [3]
    assert [shape(r["window"]) for r in D.expand(f, "single_turn").orderBy("turn").collect()] == [["s:sys", "u:u0", "a:a1*"], ["s:sys", "u:u2", "a:a3*"]]
    assert [shape(r["window"]) for r in D.expand(f, "full").collect()] == [["s:sys", "u:u0", "a:a1*", "u:u2", "a:a3*"]]
    assert D.expand(f, "prefix").count() == 2 and D.expand(f, "window", [2]).count() == 2


def test_render_and_keys(spark):
    s = F.col("segments")
    f = frame(spark, [("x", [("user", "Hi  There", False), ("assistant", "Yo", True)]), ("y", [("user", "hi there", False), ("assistant", "other", True)])])
    r = {x["id"]: x for x in f.select("id", D.render(s).alias("t"), D.prompt_key(s).alias("p"), D.record_key(s).alias("k")).collect()}
    assert r["x"]["t"] == "User: Hi  There\nAssistant: Yo"
    assert r["x"]["p"] == r["y"]["p"] and r["x"]["k"] != r["y"]["k"]


def test_budgets(spark):
    f = frame(spark, [("x", segs(("a", "aa"), ("u", "x" * 9), ("u", "bbb"), ("a", "cc"), ("u", "dd")))])
    assert shape(f.select(D.trim_budget(F.col("segments"), 10, 8).alias("s")).first()["s"]) == []
    f = frame(spark, [("x", segs(("u", "x" * 9), ("u", "bbb"), ("a", "cc"), ("u", "dd")))])
    assert [s["content"] for s in f.select(D.trim_budget(F.col("segments"), 10, 8).alias("s")).first()["s"]] == ["bbb", "cc"]
    cut = f.select(D.truncate_chars(F.col("segments"), 11).alias("s")).first()["s"]
    assert [s["content"] for s in cut] == ["x" * 9, "bb"]


def test_alternating_keeps_parity(spark):
    s = spark.createDataFrame([(["a", "", "c", "d"],)], "t array<string>").select(D.merge_adjacent(D.alternating(F.col("t"))).alias("s")).first()["s"]
    assert shape(s) == ["u:a\nc", "a:d*"]

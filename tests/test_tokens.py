import pytest
from helpers import frame, segs
from pyspark.sql import functions as F

from corpusloom.operators import metrics as M
from corpusloom.operators import packing as K
from corpusloom.operators import vocabulary as V
from corpusloom.operators import wordpiece as W

TOKENS = ["<pad>", "<unk>", "<bos>", "<eos>", "<space>", "<newline>", "<tab>", "un", "##aff", "##able", "user", "assistant", ":", "好", "a", "b", "x"]


def test_wordpiece_rules():
    w = W.WordPiece(TOKENS)
    assert w.tokenize("Unaffable 好世\n\tb?") == ["un", "##aff", "##able", "<space>", "好", "<unk>", "<newline>", "<tab>", "b", "<unk>"]
    assert w.tokenize("abx") == ["a", "b", "x"] and w.tokenize("abz") == ["a", "b", "<unk>"]
    assert w.tokenize("") == [] and w.encode(None) == []
    assert w.decode(w.encode("unaffable 好\nb")) == "unaffable 好\nb"
    assert len(w.tokenize("a" * 101)) == 101
    with pytest.raises(ValueError, match="unique"):
        W.WordPiece(["a", "a"])


def test_encode_records_and_ends(spark):
    w = W.WordPiece(TOKENS)
    r = W.encode_records(frame(spark, [("x", [("user", "a", False), ("assistant", "b", True)])]), w).first()
    names = [TOKENS[i] for i in r["tokens"]]
    assert names == ["<bos>", "user", ":", "<space>", "a", "<newline>", "assistant", ":", "<space>", "b", "<newline>", "<eos>"]
    assert r["mask"] == [False] * 6 + [True] * 6
    ids = spark.createDataFrame([("a b",), ("",)], "t string").select(W.with_ends(W.encode_udf(w)(F.col("t")), w, True, True, 4, True).alias("i")).collect()
    assert [TOKENS[i] for i in ids[0]["i"]] == ["<bos>", "a", "<space>", "<eos>"] and [TOKENS[i] for i in ids[1]["i"]] == ["<bos>", "<eos>", "<pad>", "<pad>"]


def test_spans_weights_draws(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 7)], "o int, n int")
    assert [(r["start"], r["end"]) for r in K.spans(df, "n", ["o"]).orderBy("o").collect()] == [(0, 5), (5, 8), (8, 15)]
    m = spark.createDataFrame([([False, False, True, True, True],), ([True],), ([],)], "m array<boolean>").select(K.trainable(F.col("m")).alias("w")).collect()
    assert [r["w"] for r in m] == [3, 0, 0]
    t = K.cumulative_weights(spark.createDataFrame([(1, 2), (2, 0), (3, 200_000)], "o int, w bigint"), "w", ["o"])
    d = spark.createDataFrame([(0,), (1,), (2,), (150_000,), (200_001,)], "draw bigint")
    assert sorted((r["draw"], r["o"]) for r in K.draw_lookup(d, "draw", t).collect()) == [(0, 1), (1, 1), (2, 3), (150_000, 3), (200_001, 3)]


def test_windows_xy(spark):
    rows = spark.createDataFrame([(1, [2, 7, 8, 3], [False, False, True, True]), (2, list(range(40)), [i % 2 == 0 for i in range(40)])], "o int, tokens array<int>, mask array<boolean>")
    w = K.sample_windows(rows, 200, 6, 5, ["o"]).collect()
    assert len(w) == 200 and {r["o"] for r in w} == {1, 2}
    for r in w:
        assert len(r["x"]) == len(r["y"]) == 6 and any(y != -100 for y in r["y"])
    short = next(r for r in w if r["o"] == 1)
    assert short["x"] == [2, 7, 8, 0, 0, 0] and short["y"] == [-100, 8, 3, -100, -100, -100]
    c = spark.createDataFrame([([True, True, False, True],)], "m array<boolean>").select(K.supervised_chunks(F.col("m")).alias("c")).first()["c"]
    assert [tuple(x) for x in c] == [(0, 2), (3, 4)]


def test_limit_chars(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, "b" * 10), (3, "c" * 10), (4, "d")], "o int, t string")
    assert [(r["o"], len(r["kept"]), r["cut"]) for r in K.limit_chars(df, "t", ["o"], 25).orderBy("o").collect()] == [(1, 10, False), (2, 10, False), (3, 5, True)]
    assert K.limit_chars(df, "t", ["o"], 20).count() == 2


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "the cat the dog 好"), (2, "dog 好 it's"), (3, None)], "o int, t string")
    f = V.token_frequencies(docs, "t", "o")
    assert [(r["token"], r["n"]) for r in V.top_tokens(f, 4).orderBy("rank").collect()] == [("好", 2), ("the", 2), ("dog", 2), ("cat", 1)]
    src = spark.createDataFrame([("Dog", 0), ("##ing", 1), ("好", 2), ("cat", 3), ("坏", 4), ("[X]", 5), ("the", 6), ("狗好", 7)], "token string, ord int")
    base = len(dict.fromkeys([*V.SPECIAL_TOKENS, *V.ASCII_FALLBACK, *V.COMMON_PUNCTUATION]))
    got = [r["token"] for r in V.prune(src, base + 5, {"cjk": 1, "word": 2, "piece": 5}).orderBy("id").collect()][base:]
    assert got == ["好", "dog", "cat", "##ing", "坏"]
    by_count = [r["token"] for r in V.prune(src, base + 4, {"cjk": 1, "word": 2}, freq=f).orderBy("id").collect()][base:]
    assert by_count == ["好", "the", "dog", "##ing"]


def test_metrics(spark):
    p = spark.createDataFrame([(1, 1), (2, 1), (None, 1)], "y int, p int")
    assert M.accuracy(p, "y", "p").first()["accuracy"] == 50.0
    logits = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, 0.0], -100)], "l array<double>, g int")
    assert abs(M.masked_loss(logits, "l", "g").first()["loss"] - 0.6931471805599453) < 1e-12
    assert M.masked_loss(logits.where("g < 0"), "l", "g").first()["loss"] == 0
    d = spark.createDataFrame([([0.2, 0.3, 0.5],)], "p array<double>").select(*[M.draw_index(F.col("p"), F.lit(u)).alias(n) for n, u in (("a", 0.1), ("b", 0.2), ("c", 0.99), ("d", 1.0))]).first()
    assert tuple(d) == (0, 1, 2, 2)
    assert abs(spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(M.ema(F.col("v")).alias("e")).first()["e"] - 1.1) < 1e-12
    g = M.gather_embeddings(spark.createDataFrame([(1, [5, 9])], "k int, ids array<int>"), "k", "ids", spark.createDataFrame([(5, [1.0])], "id int, v array<double>"), "id", "v", 2.0).collect()
    assert [tuple(r) for r in g] == [(1, 0, [2.0])]


def test_ema_over_ranges(spark):
    rows = [("hot", i, float(i % 7)) for i in range(500)] + [("one", 1, 2.5), ("gap", 1, None), ("gap", 2, 4.0), ("gap", 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(6)
    want = {}
    for k, _, v in rows:
        if v is not None:
            want[k] = v if k not in want else want[k] * 0.9 + v * 0.1
    got = {r["k"]: r["ema"] for r in M.ema_by(df, "k", ["o"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

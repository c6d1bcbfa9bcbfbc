import random

from pyspark.sql import functions as F

from corpusloom.llm import budget, containers, encode
from corpusloom.llm.common import TOKENIZERS, byte_encoder


def test_ids_and_round_trip(spark):
    texts = ["", None, "Hello  world\n\n ok", " don't  'S 's\t\x1c\x85 x", "语料库。 好 123abc", "<|endoftext|>", "the " * 5000, "🎉👩‍🚀͸ ไทย", "á   b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "null id")], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("n", F.lit(2))
    out = encode.encode_corpus(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    enc = byte_encoder(TOKENIZERS, "byte_bpe_50k")
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)} | {None: enc.encode_ordinary("null id")}
    assert out.count() == len(texts) + 1
    back = {r["doc_id"]: r["text"] for r in encode.decode_corpus(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "null id"}


def test_documents_like_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    enc = byte_encoder(TOKENIZERS, "byte_bpe_50k")
    want = {r["doc_id"]: enc.encode_ordinary(r["text"] or "") for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in encode.encode_corpus(docs).collect()} == want


def test_length_buckets_like_brute_force():
    from itertools import combinations

    rnd = random.Random(4)
    for _ in range(20):
        h = {x: rnd.randrange(1, 9) for x in rnd.sample(range(1, 40), 8)}
        lens = sorted(h)
        cost = lambda b: sum(n * (min(u for u in b if u >= x) - x) for x, n in h.items())  # noqa: E731, B023
        best = min(cost([*c, lens[-1]]) for k in range(3) for c in combinations(lens[:-1], k))
        got = containers.length_buckets(h, 3)
        assert len(got) <= 3 and cost(got) == best
    assert containers.length_buckets({}, 3) == []


def test_shapes_use_up_the_histogram():
    rnd = random.Random(5)
    h = {x: rnd.randrange(1, 50) for x in rnd.sample(range(1, 101), 60)}
    shapes = containers.batch_shapes(h, containers.length_buckets(h, 5), 100)
    used = {}
    for times, shape in shapes:
        assert sum(x * c for x, c in shape.items()) <= 100 and times > 0
        for x, c in shape.items():
            used[x] = used.get(x, 0) + times * c
    assert used == h and len(shapes) <= len(h)


def test_containers(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([7, 7, 7, rnd.randrange(0, 300)])) for i in range(3000)] + [(9001, 250), (9001, 250)]
    items = containers.split_oversize(spark.createDataFrame(rows, "doc_id bigint, n bigint"), 100)
    out = containers.fill_containers(items, ["doc_id", "part"], 100, 6, top_up=True).collect()
    assert sum(r["n_tokens"] for r in out) == sum(n for _, n in rows)
    load = {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        assert r["n_tokens"] <= 100 and (r["n_tokens"] == 0 or r["bucket"] >= r["n_tokens"])
    assert max(load.values()) <= 100
    full = -(-sum(load.values()) // 100)
    assert len([c for c, t in load.items() if t]) <= full * 1.02 + 1
    inside = containers.fill_containers(items, ["doc_id", "part"], 100, 6).collect()
    held, mixed = {}, {}
    for r in inside:
        held[r["container"]] = held.get(r["container"], 0) + r["n_tokens"]
        if r["n_tokens"]:
            mixed.setdefault(r["container"], set()).add(r["bucket"])
    assert len(inside) == len(out) and sum(held.values()) == sum(load.values()) and max(held.values()) <= 100
    assert all(len(b) == 1 for b in mixed.values())  # token-budget batches form inside each bucket
    split = {r["doc_id"] for r in out if r["part"] > 0}
    assert split == {i for i, n in rows if n > 100}
    assert containers.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert containers.container_report(containers.pack_documents(spark.createDataFrame([(1, None), (2, "a b")], "doc_id bigint, text string"))).first()["containers"] == 1


def test_document_tokens(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    enc = byte_encoder(TOKENIZERS, "byte_bpe_50k")
    want = sorted((r["doc_id"], len(enc.encode_ordinary(r["text"] or ""))) for r in d.collect())
    assert sorted(map(tuple, budget.document_tokens(d).collect())) == want


def test_budget_like_brute_force(spark, sf, profiles):
    t, d = spark.read.parquet(f"{sf}/training_records.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    s = budget.record_slices(t).unionByName(budget.document_slices(d))
    enc = byte_encoder(TOKENIZERS, "byte_bpe_50k")
    want = {}
    for r in s.distinct().collect():
        k = (r["tbl"], r["source"], r["role"], r["domain"])
        n, m = want.get(k, (0, 0))
        want[k] = (n + 1, m + len(enc.encode_ordinary(r["text"])))
    got = {}
    for r in budget.token_budget(s, profiles).collect():
        k = (r["tbl"], r["source"], r["role"], r["domain"])
        n, m = got.get(k, (0, 0))
        got[k] = (n + r["texts"], m + r["tokens"])
    assert got == want


def test_budget_holds_rejected_segments(spark, profiles):
    seg = "array<struct<role string, content string, train boolean>>"
    good, bad = [("user", "hi", None), ("bot", "yes", None)], [("bot", "no thanks", None), ("bot", None, None)]
    df = spark.createDataFrame([("a", "S", good, bad, None), ("b", "s", good, None, None), ("c", "s", None, bad, None)], f"id string, source string, segments {seg}, rejected_segments {seg}, meta string")
    got = sorted((r["tbl"], r["id"], r["part"], r["role"], r["text"]) for r in budget.record_slices(df).collect())
    x, y = "training_records", "training_records.rejected"
    assert got == [(x, i, p, r, t) for i in "ab" for p, r, t in ((0, "user", "hi"), (1, "assistant", "yes"))] + [(y, i, p, "assistant", t) for i in "ac" for p, t in ((0, "no thanks"), (1, ""))]
    n = len(byte_encoder(TOKENIZERS, "byte_bpe_50k").encode_ordinary("no thanks"))
    assert sum(r["tokens"] for r in budget.token_budget(budget.record_slices(df), profiles).collect() if r["tbl"] == y) == 2 * n

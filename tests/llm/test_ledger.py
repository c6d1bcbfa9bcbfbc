import datetime as dt
import json
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import ledger

T = [dt.datetime(2024, 1, d) for d in range(1, 9)]
DDL = "id string, source string, segments array<struct<role string, content string, train boolean>>, ingested_at timestamp"


def test_records_hidden_copies(spark):
    seg = lambda *c: [("user" if i % 2 == 0 else "gpt", x, None) for i, x in enumerate(c)]
    rows = [
        ("b", "My Src", seg("Grüße!", "ok"), T[0]), ("a", "my-src", seg("  GRÜSSE", "«OK»"), T[5]), ("c", "mysrc", seg("grüße", "ok?"), T[1]), ("c", "mysrc", seg("grüße", "ok?"), T[6]),
        ("d", "mysrc", seg("grüße"), T[2]), ("e", None, None, T[2]), ("f", "", [], T[7]), ("g", "x", [("user", None, None)], T[1]), ("h", "x", [("human", "", True)], T[1]), ("i", "y", [("user", "a b", None)], T[3]), ("j", "y", [("user", "a", None), ("user", "b", None)], T[3]), (None, "y", seg("z"), T[1]),
    ]
    df = spark.createDataFrame(rows, DDL).withColumn("key", F.lit("clash")).withColumn("copies", F.lit(9))
    k = ledger.keyed_records(df)
    assert sorted((r["id_a"], r["id_b"]) for r in ledger.hidden_duplicates(k).collect()) == [("a", "b"), ("a", "c"), ("e", "f"), ("g", "h")]
    assert sorted((r["id"], r["copies"]) for r in ledger.collapse(k).collect()) == [("b", 3), ("d", 1), ("e", 2), ("g", 2), ("i", 1), ("j", 1)]


def test_raw_lines(spark):
    a = {"source": "s", "id": "1", "segments": [{"role": "user", "content": "Hi, you"}]}
    lines = [json.dumps(a), json.dumps({"segments": [{"content": "hi you!", "role": "User "}], "source": "S"}), json.dumps(a) + "}", "// " + json.dumps(a), "", None, "[]", '"x"', "{}", '{"source": null}']
    df = spark.createDataFrame([(f"r{i}", x, T[i % 8]) for i, x in enumerate(lines)], "raw_id string, line string, loaded_at timestamp")
    assert [(r["id_a"], r["id_b"]) for r in ledger.hidden_duplicates(ledger.keyed_raw(df)).orderBy("id_a").collect()] == [("r0", "r1"), ("r8", "r9")]


def test_incremental_equals_whole_with_hot_key(spark, tmp_path):
    rnd = random.Random(2)
    rows = [("t", f"{i:04d}", ("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(200)}").encode(), T[rnd.randrange(4)]) for i in range(2000)]
    again = [(t, i, k, T[5]) for t, i, k, _ in rows[:700]]  # delivered again in a later batch
    df = spark.createDataFrame([(t, i, bytearray(k), a) for t, i, k, a in rows + again], "tbl string, id string, key binary, at timestamp")
    book = ledger.Ledger(spark, str(tmp_path / "book"), 16)
    for d in (0, 1, 2, 3, 5):
        book.update(df.where(F.col("at") == T[d]))
    book.update(df.where(F.col("at") == T[7]))  # an empty batch
    got = {bytes(r["key"]): (r["copies"], r["first"]["id"], r["least_id"]) for r in book.table().collect()}
    want = {}
    for _, i, k, a in rows:
        n, f, m = want.get(k, (0, (a, i), i))
        want[k] = (n + 1, min(f, (a, i)), min(m, i))
    assert got == {k: (n, f[1], m) for k, (n, f, m) in want.items()}
    assert book.members().count() == len(rows)
    # Only the buckets asked for are read.
    one = book.table({3})
    assert {r["bucket"] for r in one.collect()} == {3} and all("bucket=3/" in f for f in one.inputFiles())


def test_unfinished_batch_is_not_read(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"), 2)
    df = spark.createDataFrame([("t", "a", bytearray(b"k"), T[0])], "tbl string, id string, key binary, at timestamp")
    book._write(df.withColumn("bucket", F.lit(1)), "members", 1)
    assert book.members().count() == 0
    book.update(df)
    assert [r["copies"] for r in book.table().collect()] == [1]


def test_whole_tables_like_brute_force(spark, sf):
    t = spark.read.parquet(f"{sf}/training_records.parquet")
    alias = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant"}
    groups = {}
    for r in t.collect():
        role = lambda s: alias.get((s["role"] or "").strip().lower(), (s["role"] or "").strip().lower())
        flat = lambda x: re.sub(r"[\W_]+", "", (x or "").casefold())
        groups.setdefault((flat(r["source"]), tuple((role(s), flat(s["content"])) for s in r["segments"] or [])), set()).add(r["id"])
    want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert sorted((r["id_a"], r["id_b"]) for r in ledger.hidden_duplicates(ledger.keyed_records(t)).collect()) == want


def test_empty(spark):
    assert ledger.hidden_duplicates(ledger.keyed_records(spark.createDataFrame([], DDL))).count() == 0

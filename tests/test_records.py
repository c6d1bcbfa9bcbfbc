import pytest
from helpers import frame, segs, shape
from pyspark.sql import functions as F

from corpusloom.operators import quality as Q
from corpusloom.operators import records as R


def test_make_record_and_roles(spark):
    f = frame(spark, [("x", segs(("Human", " a\r\n"), ("bot", "b"), ("t", "")))])
    r = R.make_record(f, F.col("id"), F.lit("src"), F.col("segments")).first()
    assert (r["schema"], r["task"], shape(r["segments"]), r["rejected_segments"]) == ("tl-corpus-v1", "sft", ["u:a", "a:b*"], None)
    with pytest.raises(Exception, match="unsupported role"):
        R.make_record(frame(spark, [("x", segs(("narrator", "z")))]), F.col("id"), F.lit("s"), F.col("segments")).collect()


def test_preference_uses_own_prompt(spark):
    f = spark.createDataFrame([("x", segs(("u", "P")), segs(("u", "P"), ("a", "X")), segs(("a", "Y")))], "id string, " + ", ".join(f"{c} array<struct<role:string,content:string,train:boolean>>" for c in ("p", "good", "bad")))
    r = R.preference_record(f, F.col("id"), F.lit("s"), F.col("p"), F.col("good"), F.col("bad")).first()
    assert shape(r["segments"]) == ["u:P", "a:X*"] and shape(r["rejected_segments"]) == ["u:P", "a:Y*"] and r["task"] == "preference"


def test_labels(spark):
    t = "lost\nUser: a\nmore\n助手：b\n\nSystem: <bos>c"
    s = R.parse_labels(spark.createDataFrame([("x", t), ("null", None)], "id string, t string"), ["id"], "t").orderBy("id").collect()
    assert s[0]["segments"] == [] and shape(s[1]["segments"]) == ["u:a\nmore", "a:b*", "s:c"]
    u = spark.createDataFrame([("User 1: hi\nnoise\nUser 2: yo",)], "t string").select(R.user_labels(F.col("t")).alias("s")).first()["s"]
    assert shape(u) == ["u:hi", "a:yo*"]


@pytest.mark.parametrize(
    ("line", "kind", "n"),
    [
        ('{"schema":"tl-corpus-v1","segments":[{"role":"user","content":"q"},{"role":"gpt","content":"a"}]}', "canonical", 2),
        ('{"messages":[{"role":"user","content":"q"}]}', "messages", 1),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversations", 2),
        ('{"instruction":"q","input":"x","output":"a"}', "instruction", 2),
        ('{"text":"t"}', "text", 1), ('{"text":null}', "text", 0), ('"just text"', "scalar", 1), ("{broken", "invalid", 0), ('{"chosen":null,"rejected":[]}', "preference", 0),
    ],
)
def test_payloads(spark, line, kind, n):
    r = R.parse_payloads(spark.createDataFrame([("x", line)], "id string, line string"), "line", "id").first()
    assert (r["kind"], len(r["segments"])) == (kind, n)


def chunks(text, size):
    out, cur = [], []
    for p in [x.strip() for x in text.split("\n\n") if x.strip()]:
        if cur and len("\n\n".join(cur)) + 2 + len(p) > size:
            out.append("\n\n".join(cur))
            cur = []
        if len(p) > size:
            out += [x for x in (p[i : i + size].strip() for i in range(0, len(p), size)) if x]
            continue
        cur.append(p)
    return out + (["\n\n".join(cur)] if cur else [])


def test_chunks_like_python(spark):
    texts = ["", "a", "aaa\n\nbbb\n\ncccc", "x" * 25 + "\n\ny", "a\n\n" + "b" * 23 + "\n\nc\n\nd", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", R.chunk_paragraphs(F.col("t"), 10).alias("c")).collect()
    for r in rows:
        assert r["c"] == chunks(texts[r["i"]] or "", 10)


def test_persona_speakers_lines(spark):
    log = ["1 your persona: p", "2 hi\tyo", "3 a\tb", "1 c\td"]
    r = R.persona_conversations(spark.createDataFrame([("f", i, v) for i, v in enumerate(log)], "file string, line_no int, value string")).orderBy("conv").collect()
    assert [(shape(x["segments"]), x["persona"]) for x in r] == [(["u:hi", "a:yo*", "u:a", "a:b*"], ["p"]), (["u:c", "a:d*"], [])]
    s = R.speaker_roles(spark.createDataFrame([("c", "10", "B", "z"), ("c", "2", "A", "x"), ("c", "3", "C", "y")], "c string, i string, w string, t string"), ["c"], "i", "w", "t").first()
    assert shape(s["segments"]) == ["u:x", "a:y*", "a:z*"]
    lines = spark.createDataFrame([("L1", "one", 1), ("L1", "last", 2), ("L3", "three", 1)], "line string, text string, o int")
    j = R.line_id_join(spark.createDataFrame([("c", ["L1", "L2", "L3"])], "conv string, ids array<string>"), "conv", "ids", lines, "line", "text", "o").first()
    assert shape(j["segments"]) == ["u:last", "u:three"]
    p = spark.createDataFrame([(["a", "", "c"], ["b", "x"])], "f array<string>, g array<string>").select(R.paired_utterances(F.col("f"), F.col("g")).alias("s")).first()["s"]
    assert shape(p) == ["u:a", "a:b*", "a:x*"]


def test_reasons(spark):
    b = Q.Bounds(max_record_chars=80, max_response_chars=20, min_english_ratio=0.5)
    cases = {
        "bad_roles": segs(("u", "q")), "no_user": segs(("a", "x")), "bad_prompt": segs(("u", "Hello."), ("a", "x")), "too_long_record_chars": segs(("u", "q" * 90), ("a", "x")),
        "too_long_response_chars": segs(("u", "why not"), ("a", "x" * 30)), "non_english": segs(("u", "почему же так вышло с этим"), ("a", "да")), "ok": segs(("u", "why not now"), ("a", "x")),
    }
    f = frame(spark, [(k, [(r, c, r == "assistant") for r, c, _ in v]) for k, v in cases.items()])
    assert all(r["id"] == r["reason"] for r in f.select("id", Q.quality_reason(F.col("segments"), b).alias("reason")).collect())


def test_message_filter(spark):
    rows = [("ok", "en", None, None, "prompter", "x", (0.5,)), ("toxic", "en", False, True, "user", "x", (0.51,)), ("nullbox", "en", False, True, "user", "x", None), ("failed", "en", False, False, "user", "x", None), ("gone", "en", True, True, "user", "x", None), ("lang", "de", False, True, "user", "x", None), ("blank", "en", False, True, "user", " ", None), ("role", "en", False, True, "system", "x", None)]
    f = spark.createDataFrame(rows, "id string, lang string, deleted boolean, review_result boolean, role string, text string, detoxify struct<toxicity double>")
    assert sorted(r["id"] for r in f.where(Q.message_ok()).collect()) == ["nullbox", "ok"]

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from helpers import shape
from pyspark.sql import functions as F

from corpusloom.operators import tree as TR
from corpusloom.sources import readers as S
from corpusloom.sources import sinks as K
from corpusloom.streaming import ingest as I


@pytest.mark.parametrize(("path", "fmt", "want"), [("a.jsonl", "auto", "jsonl"), ("a.json", "auto", "json"), ("a.md", "auto", "text"), ("a.x", "ndjson", "jsonl"), ("a.x", " TXT ", "text")])
def test_format(path, fmt, want):
    assert S.resolve_format(path, fmt) == want
    with pytest.raises(ValueError):
        S.resolve_format(path, "yaml")


def test_texts_of_any_encoding(spark, tmp_path):
    for name, data in (("a", b"\xef\xbb\xbfhi"), ("b", "中文".encode("gb18030")), ("c", b"")):
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r["path"][-5]: r["text"] for r in S.whole_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a": "hi", "b": "中文"}  # files without bytes have no row
    assert S.decode_bytes(b"\xff\xfe\xff") is not None and S.decode_bytes(None) is None


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text":"a"}\n\n{"text":"b"}\r\n')
    assert [(r["line_no"], r["value"]) for r in S.json_lines(spark, str(tmp_path / "x.jsonl")).orderBy("line_no").collect()] == [(1, '{"text":"a"}'), (3, '{"text":"b"}')]
    (tmp_path / "bad.jsonl").write_text("{}\n{oops\n")
    assert S.json_lines(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception, match="malformed"):
        S.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    r = S.read_corpus(spark, str(tmp_path / "x.jsonl"), source="s").orderBy("ord").collect()
    assert [shape(x["segments"]) for x in r] == [["t:a*"], ["t:b*"]] and r[0]["source"] == "s"
    (tmp_path / "d.json").write_text('[{"text":"a"}, {"text":"b"}]')
    assert S.read_corpus(spark, str(tmp_path / "d.json")).count() == 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m/a.txt", "L1 +++$+++ u0 +++$+++ hé +++$+++ x\nL2".encode("latin-1"))
        z.writestr("b.txt", "no")
    m = S.archive_members(spark, str(tmp_path / "z.zip"), ["m/a.txt"], "latin-1")
    lines = S.member_lines(m).orderBy("line_no").select("line_no", S.delimited(F.col("value")).alias("f")).collect()
    assert [(r["line_no"], r["f"]) for r in lines] == [(1, ["L1", "u0", "hé", "x"]), (2, ["L2"])]
    data = b"a,b\n1,2\n"
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        i = tarfile.TarInfo("c.csv")
        i.size = len(data)
        t.addfile(i, io.BytesIO(data))
    assert [r["member"] for r in S.archive_members(spark, str(tmp_path / "t.tar.gz")).collect()] == ["c.csv"]
    with gzip.open(tmp_path / "g.jsonl.gz", "wt") as g:
        g.write('["u","a","u2"]\nnot json\n{"no":"list"}\n')
    assert [shape(r["segments"]) for r in S.turn_arrays(spark, str(tmp_path / "g.jsonl.gz")).collect()] == [["u:u", "a:a*", "u:u2"]]


def test_dialogue_shapes(spark):
    v = lambda x: spark.createDataFrame([(json.dumps(x, ensure_ascii=False),)], "v string")
    assert shape(v({"conversation": ["a", "b"]}).select(S.grounded_dialogues(F.col("v")).alias("s")).first()["s"]) == ["u:a", "a:b*"]
    assert shape(v({"history": ["a"], "response": "b"}).select(S.grounded_dialogues(F.col("v")).alias("s")).first()["s"]) == ["u:a", "a:b*"]
    assert shape(v({"name": "电影", "messages": [{"message": "x"}]}).select(S.topic_dialogues(F.col("v")).alias("s")).first()["s"]) == ["s:电影", "u:x"]
    assert shape(v({"name": "Film", "messages": [{"message": "x"}]}).select(S.topic_dialogues(F.col("v")).alias("s")).first()["s"]) == ["u:x"]
    assert shape(S.task_dialogues(v({"7": {"messages": [{"role": "usr", "content": "q"}, {"role": "sys", "content": "a"}]}}), "v").first()["segments"]) == ["u:q", "a:a*"]
    assert shape(v({"dialogue": [{"user_utterance": "q", "system_utterance": ""}]}).select(S.paired_dialogues(F.col("v")).alias("s")).first()["s"]) == ["u:q"]


def test_html(spark):
    first = "<p>" + "a " * 40 + "</p><p> short </p>" + "<div><p>" + "b" * 60 + "</p></div><p>x</p><p>y</p><p>" + "c" * 60 + "</p>"
    html = f"<title>W</title><h1 class='x firstHeading'>T <b>x</b></h1><p>{'z' * 60}</p><div class='mw-parser-output'>{first}</div>"
    f = spark.createDataFrame([(html,), (None,), ("<p>open<script>s</script>",)], "h string")
    a = [r["a"] for r in f.select(S.article_udf()(F.col("h")).alias("a")).collect()]
    # Of the first five paragraphs the long ones: the sixth isn't taken for a short one.
    assert a[0]["title"] == "T x" and a[0]["content"] == ("a " * 40).strip() + "\n\n" + "b" * 60 and tuple(a[1]) == tuple(a[2]) == (None, "")


def test_news(spark):
    long = "n" * 40
    body = f"<p>{long}</p><div><p>{long}</p> tail</div><p>short</p>"
    pages = [f"<h1> H </h1><div class='content'>{body}</div>", f"<title>T</title><div class='my-article-x'>{body}</div><div class='content'><p>{'k' * 101}</p></div>", f"<article><p>{long}</p></article>", f"<article><p>no</p></article><article>{body}</article>", "", "<main>" + body + "</main>"]
    got = [tuple(r["a"]) for r in spark.createDataFrame(list(enumerate(pages)), "i int, h string").orderBy("i").select(S.news_udf()(F.col("h")).alias("a")).collect()]
    whole = "\n\n".join([long, long + " tail", long])
    assert got == [("H", whole), ("T", "k" * 101), (None, ""), (None, whole), (None, ""), (None, "")]


def test_datasets_and_archives(spark, tmp_path):
    rows = "conv_id,utterance_idx,context,prompt,speaker_idx,utterance\nc,10,x,p,2,\"last, yes\"\nc,2,x,p,1,\"two\nlines\"\nc,9,x,p,3,third\n"
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name in ("d/train.csv", "d/other.csv"):
            i = tarfile.TarInfo(name)
            i.size = len(rows.encode())
            t.addfile(i, io.BytesIO(rows.encode()))
    r = S.utterance_dialogues(S.archive_csv(spark, str(tmp_path / "t.tar.gz"), ["d/train.csv"])).collect()
    assert [(x["member"], x["conv_id"], shape(x["segments"]), x["context"]) for x in r] == [("d/train.csv", "c", ["u:two\nlines", "a:third\nlast, yes*"], "x")]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        s = " +++$+++ "
        z.writestr("c/movie_lines.txt", "\n".join([s.join(["L1", "u0", "m0", "A", "h\xe9 "]), s.join(["L2", "u1", "m0", "B", "old"]), s.join(["L2", "u1", "m0", "B", "new"]), "L3 too short"]).encode("latin-1"))
        z.writestr("c/movie_conversations.txt", s.join(["u0", "u1", "m0", "['L1', 'L2', 'L9', 'L1']"]) + "\nbad")
    r = S.movie_dialogues(spark, str(tmp_path / "m.zip")).collect()
    assert [(x["movie"], shape(x["segments"])) for x in r] == [("m0", ["u:h\xe9", "a:new*", "a:h\xe9*"])]
    t = spark.createDataFrame([(1, ["p", "q"], ["u1", "u2"], ["g1"]), (2, None, None, ["g"])], "i int, previous_utterance array<string>, free_messages array<string>, guided_messages array<string>")
    assert [shape(x["segments"]) for x in S.skill_dialogues(t).orderBy("i").collect()] == [["u:p", "a:q*", "u:u1", "a:g1*"], []]
    t.write.parquet(str(tmp_path / "hub/set/sub/train.parquet"))
    assert S.dataset(spark, str(tmp_path / "hub"), "set", "sub").count() == 2
    once, again = (S.dataset(spark, str(tmp_path / "hub"), "set", "sub", seed=3).collect() for _ in range(2))
    assert once == again
    with pytest.raises(FileNotFoundError):
        S.dataset(spark, str(tmp_path / "hub"), "set", None, "test")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", None), ("y", [("user", "q", False)])], "id string, rejected_segments array<struct<role:string,content:string,train:boolean>>")
    K.write_records(df, str(tmp_path / "out"), df.groupBy().count(), {"a": 1})
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(map(len, lines)) == [1, 2]
    K.write_token_cache(df, str(tmp_path / "cache"), {"sha": "1"})
    assert K.read_token_cache(spark, str(tmp_path / "cache"), {"sha": "1"}).count() == 2
    assert K.read_token_cache(spark, str(tmp_path / "cache"), {"sha": "2"}) is None and K.read_token_cache(spark, str(tmp_path / "none"), {}) is None
    K.save_tokenizer(["a"], str(tmp_path / "t.json"))
    assert S.token_list(str(tmp_path / "t.json")) == ["a"]
    built = []
    make = lambda: built.append(1) or ["a", "b"]
    for h, n in (("x", 1), ("x", 1), ("y", 2)):
        assert K.tokenizer_for(str(tmp_path / "g.json"), h, make) == ["a", "b"] and len(built) == n
    (tmp_path / "g.json").write_text((tmp_path / "g.json").read_text().replace('"b"', '"c"'))
    assert K.tokenizer_for(str(tmp_path / "g.json"), "y", make) == ["a", "b"] and len(built) == 3
    t = spark.createDataFrame([(1, "a"), (2, None)], "o int, t string")
    assert K.content_hash(t, "o", "t").first() == K.content_hash(t.orderBy(F.desc("o")), "o", "t").first()


def test_tree_with_cycle_and_orphan(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("c", "lost"), ("x", "y"), ("y", "x"), ("z", "x"), ("r", None)]
    p = TR.leaf_paths(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()
    by = {}
    for r in p:
        by.setdefault(r["leaf"], {})[r["id"]] = r["steps"]
    assert by == {"b": {"b": 0, "a": 1, "r": 2}, "c": {"c": 0}, "z": {"z": 0, "x": 1, "y": 2}}
    assert TR.leaf_paths(spark.createDataFrame([], "id string, up string"), "id", "up").count() == 0


def test_streaming_dedupe(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = {"schema": "tl-corpus-v1", "id": "1", "source": "s", "task": "sft", "segments": [{"role": "user", "content": "q", "train": False}]}
    (src / "a.json").write_text("\n".join(json.dumps(line | {"id": str(i)}) for i in range(3)))
    s = I.stream_records(spark, str(src)).withColumn("at", F.current_timestamp())
    I.run_once(I.deduplicate(s, "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1

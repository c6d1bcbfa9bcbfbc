import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sentences as S


def parts(text, ctx=None):
    return [text[a:b] for a, b in S.split_sentences(text, ctx)]


CASES = [
    ["Mr. Olm met Dr. Karr on Dec. 10 in Varrow.", "The price is $9.88, i.e. 35.7% more.", "See Fig. 7 and Sec. 2.3."],
    ["The job ended at 10 p.m.", "The notes by J. K. Karr list names, etc.", "It was bought by Finch Corp.", "Then nothing."],
    ['"Is it true?" asked Senna.', "Tovan replied, \"Not yet. It reads on.\"", "The page (which rarely fails!) loads."],
    ["Er kam z. B. in Tovan, d. h. fast immer, an.", "Es gibt Grüße, Namen usw.", "Das war am 3. Oktober."],
    ["«¿Está listo?», preguntó Nora.", "Tovan respondió: «Todavía no. Sigue leyendo.»", "¡Vaya!"],
    ["В 2022 г. доктор И. П. Вальн заметил это.", "Там есть имена и т. д.", "«Всё готово?» — спросил он."],
]


@pytest.mark.parametrize("want", CASES)
def test_spaced_scripts(want):
    assert parts(" ".join(want)) == want


def test_unspaced_scripts():
    zh = ["他问：“准备好了吗？还没有。”", "“好。”编辑这样说。", "（注意：他忽略空消息。）", "《对话清洗！》这本书说完了。", "真的吗？！"]
    assert parts("".join(zh)) == zh
    ja = ["彼は「準備はいいですか？まだです。」と書きました。", "値は9.16から82.7に下がりました。"]
    assert parts("".join(ja)) == ja
    th = ["ตัวตัดคำนับคำทุกคำ", "หน้าสองภาษาใช้ไฟล์ train.part-06.jsonl ที่เก่า", "แต่ค่าลดลงจาก 9.45 เหลือ 40.9"]
    assert parts(" ".join(th)) == th


def test_lines():
    assert parts("Data mixing\n\n1. First one.\n2) Second, e.g. this.\n- Third\nQ: Why?\nA: So.") == ["Data mixing", "1. First one.", "2) Second, e.g. this.", "- Third", "Q: Why?", "A: So."]
    wrapped = "The quality score favours short replies in most cases. The weekly snapshot\ncovers only half of the topics even though the input is clean, and the loss\nmask merges adjacent lines. End."
    assert parts(wrapped) == ["The quality score favours short replies in most cases.", "The weekly snapshot\ncovers only half of the topics even though the input is clean, and the loss\nmask merges adjacent lines.", "End."]
    bare = ["the first line has no mark", "the second line is quite a bit longer than that", "short"]
    assert parts("\n".join(bare)) == bare


def test_places_cover_everything():
    for t in ("﻿ Hi.  \r\n\r\nYou.The end… 🎉 ok", "a" * 50_000 + ". B.", "...", "?!", "🎉"):
        s = S.split_sentences(t)
        covered = "".join(t[a:b] for a, b in s)
        assert "".join(covered.split()) == "".join(t.replace("﻿", "").split())
        assert all(x[1] <= y[0] for x, y in zip(s, s[1:], strict=False))
    assert S.split_sentences("") == S.split_sentences(None) == S.split_sentences(" \n　") == []


def test_ellipsis_by_contexts(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    docs = spark.read.parquet(folder)
    c = S.fit_contexts(docs)
    assert parts("损失掩码……其实把文件读了两次。", c) == ["损失掩码……其实把文件读了两次。"]
    assert parts("每周快照与旧格式一致……总之，质量分数忽略空消息。", c) == ["每周快照与旧格式一致……", "总之，质量分数忽略空消息。"]


def test_decode_needs_words_between():
    assert S.decode("a. . b.", [(2, 5.0), (4, 6.0), (7, 9.0)]) == [4, 7]
    assert S.decode("", []) == []


def test_operator(spark):
    df = spark.createDataFrame([(1, "Abc. Cde."), (2, None), (3, " "), (None, "X yz.")], "doc_id bigint, text string").withColumn("start_char", F.lit("clash"))
    got = S.sentences(df, contexts=S.Contexts({}, {})).collect()
    assert sorted(((r["doc_id"] or 0), r["start_char"], r["end_char"]) for r in got) == [(0, 0, 5), (1, 0, 4), (1, 5, 9)]
    assert S.sentences(df.limit(0)).count() == 0


def test_chain_decides():
    """Blanks of scripts without marks are cut by the model: no evidence, or evidence against, and they aren't."""
    th = "ตัวตัดคำนับคำทุกคำ ป้ายภาษาอ่านไฟล์สองครั้ง"
    even = S.Contexts({}, {})
    assert parts(th, even) == [th]
    assert len(parts(th, S.Contexts({}, {}, chain={"blank": (2.0, 2.0)}))) == 2
    assert parts(th, S.Contexts({"คำ": -100.0}, {}, chain={"blank": (2.0, 2.0)})) == [th]
    assert len(parts(th, S.Contexts({"คำ": 3.0}, {}))) == 2


def test_transitions_by_expectation_maximisation():
    """Half of the places have boundary contexts; nearly all of another kind have."""
    chain = S.fit_chain([("dots", 999, 12, 500), ("dots", 999, -12, 500), ("blank", 999, 10, 990), ("blank", 10, 10, 900), ("blank", 999, -10, 10)])
    assert abs(chain["dots"][0]) < 0.3 and chain["blank"][0] > 3


def test_contexts_on_stripped_text(spark):
    """Letters at proven ends score above letters inside; every text counts, whatever the sample."""
    rows = [(i, f"เราอ่านหนังสือเล่ม{'กขคงจ'[i % 5]}แล้วนะ\n\nเขาเขียนจดหมายยาวแล้วนะ\n\n") for i in range(50)]
    c = S.fit_contexts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert c.score("วนะ", "เขา") > 2 > c.score("อ่า", "จดห")
    assert S.fit_contexts(spark.createDataFrame([], "doc_id bigint, text string")).chain == {}

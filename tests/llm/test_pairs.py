import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pairs


@pytest.fixture(scope="module")
def endings(spark, sf):
    folder = "/root/testdata/sf0.01/training_records.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    return pairs.fit_endings(spark.read.parquet(folder))


Q = "Which problems does data mixing cause, and how can they be avoided?"
CASES = [
    (Q, "", "empty"), (Q, "​", "empty"), (Q, "…", "empty"), (Q, "[no answer]", "empty"), (Q, "N/A", "empty"), (Q, "<bos><eos>", "empty"), (Q, "Done! :-)", None), (Q, "116 kg", None),
    (Q, Q, "copy"), (Q, f"> {Q.upper()}", "copy"), (f"(Ref abc1234) {Q}", f"So, {Q}", "copy"), (Q, f"{Q} The tokenizer counts every token. The chat export drops empty turns. It keeps the last answer.", None),
    ("Repeat this sentence exactly: The chat export counts every token.", "The chat export counts every token.", None), ("请原样重复这句话：聊天记录把文件读了两次。", "聊天记录把文件读了两次。", None), ("順位付けとは何ですか？", "順位付けとは何ですか？", "copy"),
    (Q, "Unfortunately, I'm not able to share such details.", "refusal"), (Q, "As a language model, I am not able to answer this question.", "refusal"), (Q, "I cannot recommend this step too strongly. A small corpus counts every token.", None), (Q, 'A reply such as "I am unable to help" would be wrong here.', None), (Q, "Sorry for the delay! The tokenizer counts every token.", None),
    ("¿Qué significa el filtro de respuestas en la práctica?", "Lo siento, pero no puedo ayudar con eso.", "refusal"), ("请解释一下。", "抱歉，我无法回答这个问题。", "refusal"), ("ทำไมป้ายภาษาจึงสำคัญ", "ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้", "refusal"), ("請解釋。", "抱歉让您久等了。验证集忽略空消息。", None),
    (Q, "Der Dialogfilter bevorzugt kurze Antworten während der Nacht.", "language"), ("Translate the following into German: The tokenizer counts every token.", "Der Tokenizer zählt jedes Wortstück.", None), ("¿Qué significa el filtro de respuestas en la práctica?", "The language tag confuses two similar words as the log shows.", "language"),
    (Q, "The tokenizer counts every token. The chat export keeps the", "truncated"), (Q, "The tokenizer counts every token. However,", "truncated"), (Q, "```python\nx = load(path)\n", "truncated"), (Q, "```python\nx = load(path)\n```", None), (Q, "A small corpus counts every token.\n2.", "truncated"), (Q, "The tokenizer counts every token", None), (Q, "The tokenizer counts every token. 🙂", None), (Q, "The tokenizer counts every token. (Datenmischung)", None), (Q, "The tokenizer counts every token (", "truncated"),
]


def test_cases(profiles, endings):
    got = pairs.judge([c[0] for c in CASES], [c[1] for c in CASES], [""] * len(CASES), profiles, endings)
    assert [(c[1], g) for c, g in zip(CASES, got, strict=True)] == [(c[1], c[2]) for c in CASES]


AGAIN = [
    (Q, f"{Q} {Q}", "copy"), (Q, f"{Q}\n\n{Q}\n\n{Q}", "copy"), (f"(Ref abc1234) {Q}", f"Question: {Q}\nAnswer: {Q}", "copy"), (Q, f"Okay. {Q}", "copy"), ("Why is it that the reader drops the last row?", "Why is it that this reader drops this last row?", "copy"),
    (Q, f"{Q} " + "The tokenizer counts every token. " * 3, None), (Q, "That's not a topic I can comment on. Is there anything else I can do for you?", "refusal"), (Q, "Hmm. My guidelines prevent me from responding to this.", "refusal"),
    (Q, "The tokenizer counts every token. Use it for many things, e.g.", "truncated"), (Q, "The tokenizer counts every token in order to", "truncated"), (Q, "4711", None), (Q, "The reader keeps the l", "truncated"),
    (Q, "I'm sorry, but I can't help with that request. " + "Please ask something else. " * 7, "refusal"), (Q, "\u201c The loss mask counts every token.\n\u201d", None), (Q, "[ no  answer " + "-" * 60 + " ]", "empty"),
]


def test_repeats_and_open_ends(profiles, endings):
    got = pairs.judge([c[0] for c in AGAIN], [c[1] for c in AGAIN], [""] * len(AGAIN), profiles, endings)
    assert [(c[1], g) for c, g in zip(AGAIN, got, strict=True)] == [(c[1], c[2]) for c in AGAIN]


def test_stock_phrases_and_fragments(spark, profiles):
    """An ending is judged by the counts over all records, a phrase that many questions get by itself; copies of one pair don't make it one."""
    body = "The reader keeps the last row. The tool drops a blank row. "
    rows = [(f"n{i}", [("user", f"{i} why?", None), ("assistant", body + f"Part {i} keeps the last row.", None)]) for i in range(30)]
    rows += [(f"s{i}", [("user", f"what is part {i}?", None), ("assistant", "Sure thing", None)]) for i in range(4)]
    rows += [(f"c{i}", [("user", "what is it?", None), ("assistant", body + "The tool drops", None)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, segments array<struct<role string, content string, train boolean>>")
    assert {r["id"] for r in pairs.defective_pairs(df, profiles).where("defect = 'truncated'").collect()} == {f"c{i}" for i in range(6)}


LATE = [
    (Q, "Hmm. No. I am unable to fulfil this request.", "refusal"), (Q, "Hmm. No. I am unable to fulfil this request. Perhaps a specialist could help you.", "refusal"),
    (Q, "I am sorry. I cannot help with that. My guidelines do not let me. They hold for everyone. They are strict. They were set long ago. Please ask something else.", "refusal"),
    (Q, "Data mixing causes repeats. Skewed sources cause more problems. Quotas avoid them. I cannot give you exact numbers.", None),
    (Q, "I cannot give you exact numbers. Data mixing mostly causes repeats, which quotas avoid.", None),
    (Q, "Der Dialogfilter bevorzugt kurze Antworten während der Nacht.\n```python\nx = load(path)\n```", "language"), (Q, "Der Dialogfilter bevorzugt kurze Antworten während der Nacht.\n\n| a | b |\n|---|---|\n| 1 | 2 |", "language"),
    ("¿Qué significa el filtro de respuestas en la práctica?", "```python\nfor row in table: print(row)\n```", None),
]


def test_whole_answers_are_read(profiles, endings):
    got = pairs.judge([c[0] for c in LATE], [c[1] for c in LATE], [""] * len(LATE), profiles, endings)
    assert [(c[1], g) for c, g in zip(LATE, got, strict=True)] == [(c[1], c[2]) for c in LATE]


def test_common_length_like_dynamic_programming():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.common_length(a, b)[0] == t[len(a)][len(b)]


def test_which_pairs(spark, profiles, endings):
    s = [("prompter", "q", False), ("gpt", "", None), ("assistant", "", True), ("user", "why is that so", None), ("bot", None, True), ("user", "x y z", None), ("assistant", "", False)]
    rows = [("a", s), ("a", s), ("b", None), ("c", []), ("d", [("assistant", "", True)]), (None, s)]
    df = spark.createDataFrame(rows, "id string, segments array<struct<role string, content string, train boolean>>").withColumn("defect", F.lit("clash"))
    assert sorted((r["id"], r["seg_idx"], r["defect"]) for r in pairs.defective_pairs(df, profiles).collect()) == [("a", 1, "empty"), ("a", 4, "empty")]


def test_long_texts(profiles, endings):
    long = "The tokenizer counts every token. " * 3000
    assert pairs.judge([long, Q], [long, long + "The chat export keeps the"], ["", ""], profiles, endings) == ["copy", "truncated"]

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.functions import text as X


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("好 的 ， a b", "好的， a b"), ("1 2", "1 2"), ("第 1 章", "第1章"), (None, None), ("", "")])
def test_tighten(spark, raw, clean):
    assert one(spark, raw, X.tighten_cjk) == clean


def test_clean_variants(spark):
    assert one(spark, "a  \r\n\r\n\r\n b\t\n", lambda c: X.clean_lines(c)) == "a\n\n b"
    assert one(spark, " a   b\nc ", lambda c: X.clean_flat(c)) == "a b c"
    assert one(spark, " a  b \n\n c ", lambda c: X.clean_each_line(c)) == "a b\nc"
    assert one(spark, "你 好_comma_世 界", lambda c: X.clean_chinese(c)) == "你好，世界"
    assert one(spark, "é", X.nfc) == "é"


def test_roles_tasks_names(spark):
    assert [one(spark, r, X.normalize_role) for r in (" Human ", "GPT", "bot", "moderator", None)] == ["user", "assistant", "assistant", "moderator", ""]
    assert one(spark, "sys", lambda c: X.normalize_role(c, True)) == "assistant"
    assert one(spark, " Lantern-Chat\t", X.name_key) == "lanternchat"
    assert one(spark, None, X.name_key) == ""


def test_case_folding(spark):
    for a, b in (("Grüße", "GRÜSSE"), ("ΣΊΣΥΦΟΣ", "σίσυφος"), ("ﬁn", "FIN"), ("", "")):
        assert one(spark, a, X.fold_case) == one(spark, b, X.fold_case)
    assert one(spark, None, X.fold_case) is None


def test_ratios_and_visibility(spark):
    assert one(spark, "abcéabcé", X.ascii_letter_ratio) == 0.75
    assert one(spark, "12", X.ascii_letter_ratio) is None
    assert one(spark, "ab", lambda c: X.is_english(c, 0.9)) is True
    assert one(spark, "ab", lambda c: X.is_english(c, 0.9, 20, False)) is False
    assert one(spark, "好的ab", X.cjk_ratio) == 0.5
    assert [one(spark, t, X.visible) for t in (None, "", " 　​﻿", "-", "好")] == [False, False, False, True, True]


def test_special_tokens_lists_variants(spark):
    assert one(spark, " <bos>a<eos> ", X.strip_special_tokens) == "a"
    assert one(spark, "4, 2,1,x,4", X.int_sizes) == [2, 4]
    assert one(spark, "['L1', 'L2']", X.literal_list) == ["L1", "L2"]
    assert one(spark, "abcdefgh", lambda c: X.shorten(c, 6)) == "abc..."
    assert one(spark, '["a", null, "b"]', lambda c: X.coerce_text(F.parse_json(c))) == "a\nb"
    assert one(spark, "null", lambda c: X.coerce_text(F.parse_json(c))) == ""
    assert one(spark, "hi", X.interactive_prompt) == "User: hi\nAssistant: "


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=20))
def test_strip_and_collapse_like_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").select("i", X.strip(F.col("v")).alias("s"), X.collapse_space(F.col("v")).alias("c")).collect()
    for r in rows:
        t = texts[r["i"]]
        if all(unicodedata.category(c) != "Cn" for c in t):
            assert r["s"] == t.strip()
            assert r["c"] == " ".join(t.split())


def test_schedules_and_softmax(spark):
    assert one(spark, 50, lambda c: N.warmup_cosine(c, 1.0, 100, 200), "int") == 0.5
    assert abs(one(spark, 200, lambda c: N.warmup_cosine(c, 1.0, 100, 200), "int")) < 1e-12
    assert one(spark, 7, lambda c: N.step_decay(c, 1.0, 3, 0.5), "int") == 0.25
    p = one(spark, [1.0, 2.0, 3.0], N.softmax, "array<double>")
    assert abs(sum(p) - 1) < 1e-12 and p == sorted(p)
    assert one(spark, [1.0, 3.0, 2.0], lambda c: N.top_k_mask(c, 2), "array<double>")[0] == float("-inf")

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language

SENTENCES = {
    "en": "The sampling step waits for the next batch.", "de": "Der Leser der Datensätze wartet auf den nächsten Stapel.", "fr": "Le lecteur de fiches attend le prochain lot.", "es": "El lector de fichas espera el siguiente lote durante la noche.",
    "pt": "O leitor de fichas espera o próximo lote durante a noite.", "ru": "Токенизатор читает файл дважды.", "zh": "验证集忽略空消息。", "ja": "会話フィルターは短い返事を好みます。", "th": "ตัวตัดคำนับคำทุกคำตอนปลายสัปดาห์",
}


def test_whole_texts(profiles):
    lang, conf, *_ = profiles.classify(list(SENTENCES.values()))
    assert [profiles.langs[i] for i in lang] == list(SENTENCES) and (conf > 0.5).all()
    assert profiles.classify(["", "123 !?", "​", "x" * 100_000 + " the end of the line"])[0][:3].tolist() == [-1, -1, -1]
    assert len(profiles.classify([])[0]) == 0


def test_held_out_accuracy(spark):
    """Fitted on documents, held against the labels of messages."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    profiles = language.fit_on(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/language_codes.parquet"))
    codes = [(c, c) for c in profiles.langs]
    rows = spark.read.parquet(f"{d}/oasst1.parquet").select("text", language.label_code(F.col("lang"), codes).alias("l")).where("l is not null and length(trim(text)) > 20").collect()
    lang = profiles.classify([r["text"] for r in rows])[0]
    same = sum(profiles.langs[i] == r["l"] for i, r in zip(lang, rows, strict=True))
    assert same / len(rows) > 0.94  # about a twentieth of the labels are wrong


def test_every_gram_of_a_profile_is_found():
    """N-grams that share a slot of the lookup table are all found, and counts above any bound keep their order."""
    import numpy as np

    texts = ["ab cd ef gh ij kl mn op qr st uv wx yz" * 40, "the reader waits for the next batch " * 3000]
    keys, times = language.count_grams(texts)
    p = language.Profiles(["en", "de"], ["Latn", "Latn"], [("en", int(k), float(np.log2(i + 1))) for i, k in enumerate(keys[np.argsort(-times, kind="stable")])])
    clash = language.Profiles.__new__(language.Profiles)
    clash.__dict__.update(p.__dict__)
    clash.slots = p.slots.copy()
    clash.extra = {}
    for n in language.ORDERS:  # every other n-gram loses its slot
        own = np.flatnonzero((p.keys >> 32) == n)[::2]
        low = (p.keys[own] & 0xFFFFFFFF).astype(np.uint32)
        clash.slots[n][low % language.SLOTS] = np.flatnonzero((p.keys >> 32) == n)[1] + 1
        o = np.argsort(low)
        clash.extra[n] = (low[o], own[o])
    a, b = p.classify(texts), clash.classify(texts)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)) and a[0].tolist() == [0, 0]


def test_label_notations(spark):
    codes = [("en", "English"), ("pt", "Portuguese"), ("ja", "Japanese")]
    labels = ["en", " EN ", "en-GB", "ja_JP", "english", "eng", "POR", "xx", "", None, "unknown", "pt-BR"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string").orderBy("i").select(language.label_code(F.col("l"), codes)).collect()]
    assert got == ["en", "en", "en", "ja", "en", "en", "pt", None, None, None, None, "pt"]


@pytest.mark.parametrize("joint", [" ", "\n", "\r\n", " / ", " | ", "\n\n"])
def test_mixed_segments(profiles, joint):
    for a, b in (("en", "de"), ("zh", "ru"), ("en", "th"), ("th", "en"), ("es", "pt"), ("ja", "fr")):
        text = SENTENCES[a] + joint + SENTENCES[b]
        (st,) = language.segment_languages(profiles, [text])
        assert [profiles.langs[x[2]] for x in st if x[4]] == [a, b], (a, b, st)
        assert st[0][0] == 0 and st[-1][1] == len(text)


def test_terms_do_not_count(profiles):
    texts = [SENTENCES["en"] + " [Datenmischung]", SENTENCES["zh"] + "「la mezcla de datos」", SENTENCES["en"] + " (损失掩码)", "", "```python\nx = 1\n```"]
    for st in language.segment_languages(profiles, texts):
        assert len({x[2] for x in st if x[4]}) <= 1


def test_found_rows(spark, profiles):
    codes = [(c, c, s) for c, s in zip(profiles.langs, profiles.scripts, strict=True)]
    rows = [(1, "en", SENTENCES["en"]), (2, "de", SENTENCES["en"]), (3, None, SENTENCES["ru"]), (4, None, " ​"), (5, None, None), (6, "xx", SENTENCES["zh"]), (6, "xx", SENTENCES["zh"])]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("confidence", F.lit(0)).withColumn("label", F.lit("de"))
    got = language.mislabelled(df, profiles, codes, "documents", "doc_id").collect()
    assert sorted((r["rec_id"], r["lang"]) for r in got) == [("2", "en"), ("3", "ru"), ("6", "zh")]
    seg = spark.createDataFrame([("a", [("user", SENTENCES["en"] + " " + SENTENCES["de"], None), ("user", None, None)]), ("b", None)], "id string, segments array<struct<role string, content string, train boolean>>")
    assert [(r["id"], r["seg_idx"], r["lang"]) for r in language.stretches(seg, profiles, True).collect()] == [("a", 0, "en"), ("a", 0, "de")]

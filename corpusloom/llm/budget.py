"""Token budget per source, language, role and domain.

Texts are hashed, each distinct text is tokenized once and its language found once,
and the exact counts are joined back to the multiplicities of its slices.  Only
hashes and slices are shuffled per row; texts move once per distinct text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import name_key, normalize_role
from corpusloom.llm.common import TOKENIZERS, byte_encoder
from corpusloom.llm.containers import count_udf
from corpusloom.llm.language import Profiles
from corpusloom.operators.skew import cut_lineage, join_unique


def text_key(c: Column) -> Column:
    return F.unhex(F.md5(c))


def record_slices(records: DataFrame) -> DataFrame:
    """(tbl, id, part, source, role, domain, text) of every segment of training_records, rejected ones as tbl 'training_records.rejected'.

    Source names are compared by letters and digits; null sources, roles and domains
    are ''; null contents are ''.
    """
    parts = lambda c, tbl: F.transform(F.coalesce(c, F.array()), lambda x, i: F.struct(F.lit(tbl).alias("tbl"), i.alias("part"), x["role"].alias("role"), x["content"].alias("content")))
    both = F.concat(parts("segments", "training_records"), parts("rejected_segments", "training_records.rejected"))
    s = records.select("id", name_key(F.col("source")).alias("source"), F.coalesce(F.get_json_object("meta", "$.domain"), F.lit("")).alias("domain"), F.explode(both).alias("s"))
    return s.select("s.tbl", F.col("id").cast("string").alias("id"), "s.part", "source", normalize_role(F.col("s.role")).alias("role"), "domain", F.coalesce("s.content", F.lit("")).alias("text"))


def document_slices(documents: DataFrame) -> DataFrame:
    """The same of documents: one part each, role 'document', the category as domain."""
    return documents.select(
        F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("part"), name_key(F.col("source")).alias("source"),
        F.lit("document").alias("role"), F.coalesce("category", F.lit("")).alias("domain"), F.coalesce("text", F.lit("")).alias("text"),
    )


def measure(texts: DataFrame, profiles: Profiles, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(h, tokens, lang) of distinct texts (h, text); texts without letters have the language ''."""
    shared = texts.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p, enc = shared.value, byte_encoder(folder, name)
        names = np.array([*p.langs, ""], dtype=object)
        for pdf in batches:
            t = pdf["text"].tolist()
            yield pd.DataFrame({"h": pdf["h"], "tokens": [len(enc.encode_ordinary(x)) for x in t], "lang": names[p.classify(t)[0]]})

    return texts.select("h", "text").mapInPandas(run, "h binary, tokens bigint, lang string")


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id_col, tokens) of every row; each distinct text is tokenized once, null and empty ones have 0 tokens."""
    keyed = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).withColumn("_h", text_key(F.col("_t")))
    once = keyed.groupBy("_h").agg(F.first("_t").alias("_t"), F.count(F.lit(1)).alias("_n"))
    table = cut_lineage(once.select("_h", "_n", count_udf(folder, name)(F.col("_t")).alias("tokens")))
    total = table.agg(F.sum("_n")).first()[0] or 0
    return join_unique(keyed.select(id_col, "_h"), table, ["_h"], "_n", total).select(id_col, "tokens")


def token_budget(slices: DataFrame, profiles: Profiles, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(tbl, source, lang, role, domain, texts, tokens): totals over `slices`.

    Equal rows (a further delivery of the same record) count once.
    """
    keyed = slices.withColumn("h", text_key(F.col("text")))
    measured = measure(keyed.select("h", "text").distinct(), profiles, folder, name)
    by = ["tbl", "source", "role", "domain"]
    counts = keyed.select(*by, "id", "part", "h").distinct().groupBy("h", *by).agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(measured, "h")
    return joined.groupBy("tbl", "source", "lang", "role", "domain").agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"))

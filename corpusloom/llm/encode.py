"""Encoding of a corpus by a public byte-level tokenizer through its distinct words.

Texts are cut into pre-tokens in the JVM, each distinct pre-token is encoded
once, and the ids go back to the positions.  Decoding joins the vocabulary's
token-byte table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import PRETOKEN, TOKENIZERS, UNASSIGNED, byte_encoder, read_ranks
from corpusloom.operators.skew import cut_lineage


def pretokens(text: Column) -> Column:
    """The pre-tokens of a text, in order; none for null and empty texts.

    Where a character is missing from this JVM's Unicode tables, the runs on both sides
    of it stay together with it: the encoder splits them by its own, newer tables.
    """
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>"))
        .when(text.rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(f"{UNASSIGNED}|{PRETOKEN}"), F.lit(0)))
        .otherwise(F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0)))
    )


def encode_udf(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(words: pd.Series) -> pd.Series:
        enc = byte_encoder(folder, name)
        return pd.Series([enc.encode_ordinary(w) for w in words], index=words.index, dtype=object)

    return encode


def word_table(words: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(word, n, ids): each distinct word with its number of occurrences, encoded once."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted.select("word", "n", encode_udf(folder, name)(F.col("word")).alias("ids")))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", hot_parts: int = 65_536) -> DataFrame:
    """(id_col, ids): the token ids of each text, without special tokens.

    Null and empty texts have an empty list.  Strings of special tokens are
    ordinary text.  Equal rows (id and text) give one row; an id with several texts
    gives a row for each; null ids are kept.

    Documents are partitioned once, by (id, text).  Words with more than 1/`hot_parts`
    of all places, at most `hot_parts` of them, are broadcast and put in place without
    a further shuffle; the rest is shuffled by word, where none is hot any more, and
    back to its document, whose parts are merged by position.
    """
    # Both branches read the same partitioned documents, so that Spark shuffles them once: the key is never null, and both use all columns.
    key = F.coalesce(F.unhex(F.md5(F.to_json(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t"))))), F.lit(b""))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), key.alias("_k"))
    one = d.groupBy("_k").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text"))
    vocabulary = word_table(d.select(F.explode(pretokens(F.col("_text"))).alias("word")), folder, name)
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    least = max(1, total // hot_parts)
    hot = F.broadcast(vocabulary.where(F.col("n") > least).select("word", "ids"))
    words = one.select("_k", "_id", F.posexplode_outer(pretokens(F.col("_text"))).alias("pos", "word")).join(hot, "word", "left")
    part = F.struct("pos", "ids")
    near = words.groupBy("_k").agg(F.first("_id").alias("_id"), F.collect_list(F.when(F.col("ids").isNotNull(), part)).alias("near"))
    cold = vocabulary.where(F.col("n") <= least).select("word", F.col("ids").alias("rare"))
    far = words.where("ids is null and word is not null").select("_k", "_id", "pos", "word").join(cold, "word")
    far = far.groupBy("_k").agg(F.first("_id").alias("_same"), F.collect_list(F.struct("pos", F.col("rare").alias("ids"))).alias("far"))
    placed = F.array_sort(F.concat("near", F.coalesce("far", F.array().cast("array<struct<pos:int,ids:array<int>>>"))))
    own = F.coalesce("_id", "_same").alias(id_col)
    return near.join(far, "_k", "left").select(own, F.flatten(F.transform(placed, lambda x: x["ids"])).alias("ids"))


def token_bytes(spark, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The vocabulary's (token, bytes); its size is the vocabulary's, about 50,000 rows."""
    rows = [(i, bytearray(b)) for b, i in read_ranks(folder, name).items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id_col, text) of rows (id_col, ids): the inverse of `encode_corpus`; no ids give ''.

    Rows must differ in (id_col, ids).  An id outside the vocabulary adds nothing.
    """
    v = F.broadcast(token_bytes(encoded.sparkSession, folder, name))
    e = encoded.select(F.col(id_col).alias("_id"), F.xxhash64("ids").alias("_h"), F.posexplode_outer("ids").alias("pos", "token"))
    parts = e.join(v, "token", "left").groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("hex")))).alias("w"))
    text = F.decode(F.unhex(F.array_join(F.transform("w", lambda x: F.coalesce(x["hex"], F.lit(""))), "")), "utf-8")
    return parts.select(F.col("_id").alias(id_col), text.alias("text"))

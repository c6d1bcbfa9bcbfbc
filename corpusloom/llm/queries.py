"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import budget, containers, encode, language, ledger, mixing, pairs, sentences, threads
from corpusloom.llm.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't fill their share, from the report of the mix."""
    return mixing.mix_report(table(spark, d, "training_records"), table(spark, d, "source_specs")).where("short").select("source")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked for and reached, per spec."""
    r = mixing.mix_report(table(spark, d, "training_records"), table(spark, d, "source_specs"))
    return r.select("source", "available", "planned", "copies", "used", "most", F.round("target_share", 9).alias("target_share"), F.round("share", 9).alias("share"))


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of each record in the mix."""
    r = table(spark, d, "training_records")
    return mixing.mix(r, mixing.plan_sources(r, table(spark, d, "source_specs")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Missing and wrong language labels, and the languages of mixed segments."""
    return language.wrong_languages(*(table(spark, d, t) for t in ("documents", "oasst1", "training_records", "language_codes")))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document."""
    docs, codes = table(spark, d, "documents"), table(spark, d, "language_codes")
    return language.detect(docs, language.fit_on(docs, codes), "text", ["doc_id"])


def p2_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Language stretches, with places and confidence, of every segment."""
    p = language.fit_on(table(spark, d, "documents"), table(spark, d, "language_codes"))
    return language.stretches(table(spark, d, "training_records"), p)


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return ledger.keyed_records(table(spark, d, "training_records")).unionByName(ledger.keyed_raw(table(spark, d, "raw_records")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that repeat another one in a different formatting."""
    return ledger.hidden_duplicates(keyed(spark, d))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with the number of its copies."""
    return ledger.collapse(keyed(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their defect."""
    p = language.fit_on(table(spark, d, "documents"), table(spark, d, "language_codes"))
    return pairs.defective_pairs(table(spark, d, "training_records"), p)


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by table, source, language, role and domain."""
    docs = table(spark, d, "documents")
    slices = budget.record_slices(table(spark, d, "training_records")).unionByName(budget.document_slices(docs))
    return budget.token_budget(slices, language.fit_on(docs, table(spark, d, "language_codes")))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document."""
    return budget.document_tokens(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations to drop, with the reason."""
    return threads.dropped_conversations(table(spark, d, "oasst1"))


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Kept conversations with ordered turns and sibling ranks."""
    return threads.conversations(table(spark, d, "oasst1"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the kept conversations, one a row."""
    c = threads.conversations(table(spark, d, "oasst1")).select(F.col("message_id").alias("conversation"), F.posexplode(F.arrays_zip("turns", "ranks")).alias("turn", "t"))
    return c.select("conversation", "turn", "t.turns.message_id", "t.turns.role", "t.turns.content", F.col("t.ranks").alias("rank"))


def p6_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Kept conversations when the likeliest parents stand in for lost ones."""
    return threads.conversations(table(spark, d, "oasst1"), hours=None, inferred=True)


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Likeliest parent of every reply, however long after it."""
    return threads.likely_parents(table(spark, d, "oasst1"), hours=None)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document decoded again from its ids."""
    return encode.decode_corpus(encode.encode_corpus(table(spark, d, "documents")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, or of each piece of one above 2,048 tokens."""
    return containers.pack_documents(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, inside buckets and topped up."""
    docs = table(spark, d, "documents")
    rows = [containers.container_report(containers.pack_documents(docs, top_up=t)).withColumn("top_up", F.lit(t)) for t in (False, True)]
    return rows[0].unionByName(rows[1])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Place of every sentence of every document."""
    return sentences.sentences(table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document with its text."""
    return sentences.sentences(table(spark, d, "documents"), with_text=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_shares, p1_mix, p2_found, p2_documents, p2_stretches, p3_found, p3_records, p4_found, p5_budget, p5_documents,
            p6_found, p6_conversations, p6_turns, p6_rebuilt, p6_links, p7_ids, p7_decoded, p8_containers, p8_report, p9_found, p9_sentences,
        )
    }

"""Writers: records with a sidecar of statistics, single documents, token caches."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, stats: DataFrame | None = None, config: dict | None = None, mode: str = "overwrite") -> None:
    """JSON lines, committed as a whole by the output committer, and `<path>.meta` with config, seconds taken and statistics.

    Null `rejected_segments` are left out of the lines.
    """
    begun = time.monotonic()
    records.write.mode(mode).option("ignoreNullFields", True).json(path)
    spark = records.sparkSession
    meta = spark.createDataFrame([(json.dumps(config or {}, ensure_ascii=False, sort_keys=True), round(time.monotonic() - begun, 3))], "config string, elapsed_sec double")
    if stats is not None:
        rows = stats.select(F.to_json(F.struct(*stats.columns)).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("stats"))  # one row per source
        meta = meta.crossJoin(rows)
    meta.coalesce(1).write.mode(mode).json(f"{path}.meta")


def crawl_metadata(rows: DataFrame) -> DataFrame:
    """One row: number of rows, and the distinct categories and sources, sorted."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("source")).alias("sources"))


def write_document(rows: DataFrame, path: str) -> None:
    """{metadata, data} with one JSON document; the rows must fit one file, as a document does."""
    data = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("data"))
    crawl_metadata(rows).select(F.struct("total", "categories", "sources").alias("metadata")).crossJoin(data).select(F.to_json(F.struct("metadata", "data")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def content_hash(df: DataFrame, order: str, text: str, levels: int = 4) -> DataFrame:
    """(sha, chars): SHA-256 over the sorted hashes of all texts, and their characters.

    A tree of hashes, three hexadecimal digits a level: with the four levels a group
    has more than some thousand hashes only above 10^17 texts, and no task ever holds
    more than one group.
    """
    n = F.coalesce(text, F.lit(""))
    h = df.select(F.sha2(F.concat_ws("\x00", F.col(order).cast("string"), n), 256).alias("h"), F.length(n).cast("bigint").alias("n"))
    h = h.select(F.col("h").alias("b"), "h", "n")
    for k in range(levels, -1, -1):
        h = h.groupBy(F.substring("b", 1, 3 * k).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), ""), 256).alias("h"), F.sum("n").alias("n"))
    return h.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("sha"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))


def write_token_cache(packed: DataFrame, path: str, manifest: dict) -> None:
    """Packed rows as Parquet with a manifest to compare before reuse."""
    packed.write.mode("overwrite").parquet(path)
    spark = packed.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").json(f"{path}.meta")


def read_token_cache(spark: SparkSession, path: str, manifest: dict) -> DataFrame | None:
    """The cache if it exists and its manifest is equal, else None."""
    try:
        rows = spark.read.schema("manifest string").json(f"{path}.meta").take(1)
    except Exception:  # the path doesn't exist
        return None
    return spark.read.parquet(path) if rows and rows[0][0] == json.dumps(manifest, sort_keys=True) else None


def save_tokenizer(tokens: list[str], path: str, config: dict | None = None) -> None:
    """A small JSON file, moved into place as a whole."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump({"id_to_token": tokens, "config": config or {}}, f, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)


def tokenizer_for(path: str, source_hash: str, build: Callable[[], list[str]], rebuild: bool = False) -> list[str]:
    """The tokens of a saved tokenizer if it was built from `source_hash` and is whole, else those of `build`, saved with it."""
    digest = lambda tokens: hashlib.sha256("\n".join(tokens).encode()).hexdigest()
    if not rebuild and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        c = saved.get("config", {})
        if c.get("source") == source_hash and c.get("tokens") == digest(saved["id_to_token"]):
            return saved["id_to_token"]
    tokens = build()
    save_tokenizer(tokens, path, {"source": source_hash, "tokens": digest(tokens)})
    return tokens

"""Whole corpus builds: source → windows → reasons → de-duplication → quota → records and statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import dedup as U
from corpusloom.operators import dialog as D
from corpusloom.operators import quality as Q
from corpusloom.operators import records as R
from corpusloom.operators.skew import cut_lineage, spread
from corpusloom.operators.wordpiece import WordPiece, count_udf


@dataclass(frozen=True)
class BuildConfig:
    """One corpus build.

    `kind` picks the validator: quality, daily, chinese or logic; `mode` the windows:
    prefix, window, single_turn or full.  `quota` bounds the records of each source
    (0: none) and `max_total` those of the whole build, `flat` cleans contents to one
    line.
    """

    kind: str = "quality"
    mode: str = "prefix"
    max_turns: int = 8
    sizes: tuple[int, ...] = (2, 4, 6)
    quota: int = 0
    max_total: int | None = None
    dedupe_prompts: bool = True
    flat: bool = False
    id_pattern: str = "record-%07d"
    bounds: Q.Bounds = field(default_factory=Q.Bounds)


def deliveries(records: DataFrame, *more: str) -> DataFrame:
    """One row (id, source, segments, …more) per id: the earliest delivery, ties by the row's hash; null ids are left out."""
    cols = ["source", "segments", *more]
    first = F.min_by(F.struct(*cols), F.struct("ingested_at", F.xxhash64(*cols)))
    return spread(records.where(F.col("id").isNotNull()).select("id", *cols, "ingested_at"), "id").groupBy("id").agg(first.alias("r")).select("id", "r.*")


def dialogs(records: DataFrame, flat: bool = True) -> DataFrame:
    """(id, source, segments): composed, cleaned and merged dialogues of the three speaking roles, the source as its name key."""
    clean = (lambda c: X.clean_flat(c, False)) if flat else (lambda c: X.clean_lines(c, False))
    d = deliveries(records).select("id", X.name_key(F.col("source")).alias("source"), X.nfc_segments(F.col("segments")).alias("segments"))
    return d.withColumn("segments", D.compact(F.col("segments"), clean=clean))


def windows(dialog: DataFrame, cfg: BuildConfig) -> DataFrame:
    """(id, source, turn[, size], window) of the configured mode."""
    if cfg.mode == "prefix":
        return D.prefix_windows(dialog, cfg.max_turns).drop("segments")
    return D.expand(dialog, cfg.mode, list(cfg.sizes)).drop("segments")


def reasoned(w: DataFrame, cfg: BuildConfig, wp: WordPiece | None = None) -> DataFrame:
    """Add `prompt_hash`, `reason` and `valid`.

    Token bounds need a tokenizer and are counted only for windows that pass the rest;
    record, prompt and every trained segment go through it as one array of texts.
    """
    s = F.col("window")
    first = {
        "quality": lambda: Q.quality_reason(s, cfg.bounds),
        "daily": lambda: Q.daily_reason(s, cfg.bounds),
        "chinese": lambda: Q.chinese_reason(s, cfg.bounds),
        "logic": lambda: F.coalesce(Q.chinese_base(s, cfg.bounds, False), F.lit("ok")) if wp else Q.logic_reason(s, cfg.bounds),
    }[cfg.kind]()
    key = D.prompt_key(s) if cfg.dedupe_prompts else D.record_key(s)
    w = w.withColumn("prompt_hash", key).withColumn("reason", first)
    if wp is not None:
        ok = F.col("reason") == "ok"
        trained = lambda x: x["train"]
        replies = F.transform(F.filter(s, trained), lambda x: X.strip(D.render_segment(x))) if cfg.kind == "logic" else F.array(D.render(s, trained))
        texts = F.concat(F.array(D.render(s), D.render(s, lambda x: ~x["train"])), replies)
        w = w.withColumn("_n", count_udf(wp)(F.when(ok, texts)))
        each = F.slice("_n", F.lit(3), F.size("_n"))
        w = w.withColumn("record_tokens", F.get("_n", F.lit(0)) + 2).withColumn("prompt_tokens", F.get("_n", F.lit(1)))  # with bos and eos
        w = w.withColumn("response_tokens", F.when(ok, F.aggregate(each, F.lit(0), lambda a, n: a + n)))
        record, prompt = F.col("record_tokens"), F.col("prompt_tokens")
        then = Q.logic_reason(s, cfg.bounds, record, prompt, each) if cfg.kind == "logic" else Q.token_reason(record, prompt, F.col("response_tokens"), cfg.bounds)
        w = w.withColumn("reason", F.when(ok, then).otherwise(F.col("reason"))).drop("_n")
    return w.withColumn("valid", F.col("reason") == "ok")


def judged(w: DataFrame, order: list[str]) -> DataFrame:
    """The narrow part of reasoned windows, written once, so that they aren't built twice."""
    return cut_lineage(w.select("source", *order, "prompt_hash", "reason", "valid"))


def order_of(cfg: BuildConfig) -> list[str]:
    return ["id", "turn", "size"] if cfg.mode == "window" else ["id", "turn"]


TOKEN_SUMS = {"sum_record_tokens": "record_tokens", "sum_prompt_tokens": "prompt_tokens", "sum_response_tokens": "response_tokens"}


def build(records: DataFrame, cfg: BuildConfig, wp: WordPiece | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted windows as canonical records, and statistics per source.

    Statistics: scanned dialogues, candidate windows, written, duplicates, skipped with
    their reasons, token sums (with a tokenizer) and `written_chars`, the characters of
    the records as JSON.  Windows behind the one that fills a source's quota, or the
    whole build, aren't counted.  The narrow part of every window is judged and written
    once; only accepted windows are built again, for their records.
    """
    order = order_of(cfg)
    d = dialogs(records, cfg.flat)
    j = reasoned(windows(d, cfg), cfg, wp)
    counts = [c for c in TOKEN_SUMS.values() if c in j.columns]
    narrow = cut_lineage(j.select("source", *order, "prompt_hash", "reason", "valid", *counts))
    w = U.first_valid(narrow, "prompt_hash", order)
    if cfg.quota:
        got = U.source_quota(w.where(F.col("status") == "accepted"), "source", order, cfg.quota)
        last = got.where(F.col("rank") == cfg.quota).select("source", F.struct(*order).alias("_last"))  # one row per full source
        w = w.join(last, "source", "left").where(F.col("_last").isNull() | (F.struct(*order) <= F.col("_last"))).drop("_last")
    accepted = cut_lineage(U.number(w.where(F.col("status") == "accepted"), cfg.id_pattern, ["source", *order], col="record_id", limit=cfg.max_total))
    if cfg.max_total is not None:
        end = accepted.agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("source", *order)).alias("_end"))  # one row
        w = w.join(F.broadcast(end), F.lit(True)).where((F.col("_n") < cfg.max_total) | (F.struct("source", *order) <= F.col("_end"))).drop("_n", "_end")
    full = windows(d, cfg).join(accepted.select(*order, "record_id", *counts), order)
    meta = F.to_json(F.struct(F.col("id").alias("dialog"), F.col("turn"), D.turn_count(F.col("window")).alias("window_turns"), *counts))
    out = R.make_record(full, F.col("record_id"), F.col("source"), F.col("window"), meta, F.lit("sft"), compose=False)
    stats = U.counters(w, ["source"], sums={k: v for k, v in TOKEN_SUMS.items() if v in counts}, dialog="id")
    return out, stats.join(written_chars(out), "source", "left").withColumn("written_chars", F.coalesce("written_chars", F.lit(0)))


def written_chars(records: DataFrame) -> DataFrame:
    """(source, written_chars): characters of the records as JSON lines."""
    return records.groupBy("source").agg(F.sum(F.length(F.to_json(F.struct(*records.columns)))).cast("bigint").alias("written_chars"))


def totals(stats: DataFrame) -> DataFrame:
    """One row: the sums over all sources of a build's statistics."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c, t in stats.dtypes if t == "bigint"])


def merge_corpora(corpora: Iterable[tuple[str, DataFrame]], dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """Union of canonical corpora in order, the first of equal records kept, and counts per corpus (input, written, duplicates)."""
    both: DataFrame | None = None
    for k, (name, df) in enumerate(corpora):
        part = df.withColumn("corpus", F.lit(name)).withColumn("corpus_ord", F.lit(k))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    if both is None:
        raise ValueError("no corpora")
    body = [c for c in both.columns if c not in ("corpus", "corpus_ord")]
    keyed = both.withColumn("_k", F.sha2(F.to_json(F.struct(*sorted(body))), 256))
    if not dedupe:
        stats = keyed.groupBy("corpus").agg(F.count(F.lit(1)).alias("input"), F.count(F.lit(1)).alias("written"), F.lit(0).cast("bigint").alias("duplicates"))
        return both.drop("corpus_ord"), stats
    first = keyed.groupBy("_k").agg(F.min(F.struct("corpus_ord", "corpus", *body)).alias("r"), F.count(F.lit(1)).alias("n"))
    out = first.select(*[F.col(f"r.{c}").alias(c) for c in (*body, "corpus")])
    inputs = keyed.groupBy("corpus").agg(F.count(F.lit(1)).alias("input"))
    written = out.groupBy("corpus").agg(F.count(F.lit(1)).alias("written"))
    stats = inputs.join(F.broadcast(written), "corpus", "left").select("corpus", "input", F.coalesce("written", F.lit(0)).alias("written"), (F.col("input") - F.coalesce("written", F.lit(0))).alias("duplicates"))
    return out, stats


def chat_mix(sources: list[tuple[str, DataFrame, int]], max_turns: int = 12, max_chars: int = 6000, **bounds) -> DataFrame:
    """Trimmed, filtered dialogues (id, segments) of several sources, without repeats, within their quotas."""
    ready = []
    for name, df, quota in sources:
        s = D.trim_budget(D.compact(F.col("segments"), clean=lambda c: X.normalize_text(F.replace(c, F.lit("_comma_"), F.lit(",")), False)), max_turns, max_chars)
        d = df.select("id", X.nfc_segments(F.col("segments")).alias("segments")).select("id", s.alias("segments")).withColumn("valid", Q.chat_mix_ok(F.col("segments"), **bounds))
        ready.append((name, d.withColumn("hash", D.record_key(F.col("segments"), with_train=False, roles=("user", "assistant"))), quota))
    return U.fold_sources(ready, "hash", ["id"])


def text_records(documents: DataFrame, min_chars: int = 1, max_chars: int | None = 6000, max_records: int | None = None) -> DataFrame:
    """(doc_id, source, text) of texts with at least `min_chars` characters, cut to `max_chars`; `max_records` keeps the first by doc_id."""
    t = documents.select("doc_id", "source", X.normalize_text(F.col("text")).alias("text")).where(F.length("text") >= min_chars)
    if max_chars is not None:
        t = t.withColumn("text", X.rstrip(F.substring("text", 1, max_chars)))
    return t if max_records is None else t.orderBy("doc_id").limit(max_records)

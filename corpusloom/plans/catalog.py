"""Queries of the core operators by name; `oracle` holds their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import numeric as N
from corpusloom.functions import text as X
from corpusloom.operators import dedup as U
from corpusloom.operators import dialog as D
from corpusloom.operators import generate as G
from corpusloom.operators import metrics as M
from corpusloom.operators import packing as K
from corpusloom.operators import quality as Q
from corpusloom.operators import records as R
from corpusloom.operators import tree as TR
from corpusloom.operators import vocabulary as V
from corpusloom.operators import wordpiece as W
from corpusloom.operators.skew import cut_lineage
from corpusloom.plans import pipelines as P
from corpusloom.plans.oracle import oracle_sql
from corpusloom.sources import readers as S
from corpusloom.sources import sinks as K2

__all__ = ["oracle_sql", "queries"]

BOUNDS = Q.Bounds(max_record_chars=2000, max_prompt_chars=1200, max_response_chars=600, min_english_ratio=0.6)
DAILY = Q.Bounds(max_record_chars=900, max_response_chars=400)
CHINESE = Q.Bounds(min_record_chars=20, max_record_chars=900, min_response_chars=12, max_response_chars=300, min_cjk_ratio=0.6, min_cjk_chars=2, max_ascii_letters=24)

LOGIC = Q.Bounds(min_record_chars=20, max_record_chars=900, min_response_chars=16, max_response_chars=90, min_cjk_ratio=0.5, min_cjk_chars=2, max_ascii_letters=60)
TOKEN_BOUNDS = replace(BOUNDS, min_record_tokens=24, max_record_tokens=640, max_prompt_tokens=420, min_response_tokens=12, max_response_tokens=260)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark: SparkSession, d: str) -> DataFrame:
    return P.dialogs(table(spark, d, "training_records"))


def _shown(w: DataFrame, *extra: str) -> DataFrame:
    s = F.col("window")
    text = F.array_join(F.transform(s, lambda x: F.concat(x["role"], F.lit(":"), x["content"], F.lit(":"), x["train"].cast("int").cast("string"))), "|")
    return w.select("id", "turn", *extra, F.size(s).alias("n"), F.sha2(text, 256).alias("digest"))


def dialog_segments(spark, d):
    s = F.col("segments")
    text = F.array_join(F.transform(s, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return base(spark, d).select("id", "source", F.size(s).alias("n"), D.turn_count(s).alias("turns"), F.sha2(text, 256).alias("digest"))


def prefix_windows(spark, d):
    return _shown(D.prefix_windows(base(spark, d), 8))


def context_windows_2_4_6(spark, d):
    return _shown(D.context_windows(base(spark, d), [2, 4, 6]), "size")


def sliding_window_3(spark, d):
    return _shown(D.context_windows(base(spark, d), [3]))


def single_turn_pairs(spark, d):
    return _shown(D.single_turns(base(spark, d)))


def short_dialogs(spark, d):
    """Which windows of three turns a short dialogue corpus would take."""
    w = D.context_windows(base(spark, d), [3])
    return w.select("id", "turn", Q.short_dialog_ok(F.col("window"), 2, (0, 900), (1, 300)).alias("ok"))


def full_dialog(spark, d):
    return _shown(D.expand(base(spark, d), "full"))


def _windows(spark, d, bounds=BOUNDS, kind="quality"):
    cfg = P.BuildConfig(kind=kind, max_turns=8, flat=True, bounds=bounds)
    return P.reasoned(P.windows(base(spark, d), cfg), cfg)


def prompt_dedup_first_valid(spark, d):
    w = U.first_valid(P.judged(_windows(spark, d), ["id", "turn"]), "prompt_hash", ["id", "turn"])
    return w.select("id", "turn", "prompt_hash", "reason", "status")


def dedup_counters(spark, d):
    return U.counters(U.first_valid(P.judged(_windows(spark, d), ["id", "turn"]), "prompt_hash", ["id", "turn"]), ["source"], reason=None, dialog="id")


def _skips(spark, d, by, bounds=BOUNDS, kind="quality"):
    """Reasons of the windows that no accepted one of their prompt came before: duplicates are told first."""
    return U.skip_reasons(U.first_valid(P.judged(_windows(spark, d, bounds, kind), ["id", "turn"]), "prompt_hash", ["id", "turn"]), by)


def skip_reason_hist(spark, d):
    return _skips(spark, d, ["source"])


def daily_reason_hist(spark, d):
    return _skips(spark, d, [], DAILY, "daily")


def chinese_reason_hist(spark, d):
    return _skips(spark, d, [], CHINESE, "chinese")


def logic_reason_hist(spark, d):
    return _skips(spark, d, [], LOGIC, "logic")


def source_quota(spark, d):
    w = U.first_valid(P.judged(_windows(spark, d), ["id", "turn"]), "prompt_hash", ["id", "turn"]).where("status = 'accepted'")
    return U.source_quota(w.select("source", "id", "turn"), "source", ["id", "turn"], 20)


def merge_fold(spark, d):
    w = P.judged(_windows(spark, d), ["id", "turn"]).drop("reason")
    named = {"worldtalk": 40, "smalltalkzh": 1000, "lanternchat": 0, "orchardpairs": 25}
    src = [(s, w.where(F.col("source") == s), q) for s, q in named.items()] + [("rest", w.where(~F.col("source").isin(*named)), 1_000_000)]
    src = [(s, x.drop("source"), q) for s, x, q in src]
    return U.fold_sources(src, "prompt_hash", ["id", "turn"]).select("source_name", "id", "turn", "rank")


def english_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.ascii_letter_ratio(F.col("text")), 6).alias("ratio"), X.is_english(F.col("text"), 0.7).alias("is_english"))


def cjk_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cjk_count(F.col("text")).alias("cjk"), F.round(X.cjk_ratio(F.col("text")), 6).alias("ratio"))


def bad_prompts(spark, d):
    return D.prefix_windows(base(spark, d)).select("id", "turn", Q.bad_prompt(F.col("window")).alias("bad"))


def language_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.language_ok(F.col("lang")).alias("ok"))


def message_filter(spark, d):
    return table(spark, d, "oasst1").where(Q.message_ok()).select("message_id", "ingested_at")


def text_records(spark, d):
    return P.text_records(table(spark, d, "documents"), 100).select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def char_budget(spark, d):
    r = K.limit_chars(P.text_records(table(spark, d, "documents"), max_chars=None).select("doc_id", "text"), "text", ["doc_id"], 50_000)
    return r.select("doc_id", F.length("kept").alias("chars"), "cut", F.when(F.col("cut"), "lm").alias("task"))


def doc_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(R.chunk_paragraphs(F.col("text"), 300)).alias("chunk", "content"))
    return c.select("doc_id", "chunk", F.length("content").alias("chars"), F.sha2("content", 256).alias("digest"))


def word_freq_topk(spark, d):
    return V.top_tokens(V.token_frequencies(table(spark, d, "documents"), "text", "doc_id"), 100)


def source_vocabulary(f: DataFrame) -> DataFrame:
    """Word and character types in order of first occurrence, with their last three letters as pieces, as a source vocabulary."""
    words = f.select("token", F.col("first.o").alias("o"), F.col("first.p").alias("p"))
    pieces = words.where(F.length("token") > 4).select(F.concat(F.lit("##"), F.substring("token", -3, 3)).alias("token"), "o", "p")
    one = words.unionByName(pieces).groupBy("token").agg(F.min(F.struct("o", "p")).alias("at"))
    return U.number(one.select("token", F.col("at.o").alias("o"), F.col("at.p").alias("p")), "%d", ["o", "p", "token"], col="ord").select("token", F.col("ord").cast("bigint").alias("ord"))


def vocab_prune(spark, d):
    freq = cut_lineage(V.token_frequencies(table(spark, d, "documents"), "text", "doc_id"))
    return V.prune(source_vocabulary(freq), 1200, {"cjk": 300, "word": 500, "piece": 100}, freq=freq)


def _wordpiece(spark, d) -> W.WordPiece:
    """At most 1,200 tokens reach the driver."""
    return W.WordPiece([r["token"] for r in vocab_prune(spark, d).orderBy("id").collect()])


def token_counts(spark, d):
    wp = _wordpiece(spark, d)
    return table(spark, d, "documents").select("doc_id", F.size(W.encode_udf(wp)(F.col("text"))).alias("tokens"))


def packed_records(spark, d):
    wp = _wordpiece(spark, d)
    r = W.encode_records(base(spark, d).where("size(segments) > 1"), wp)
    r = K.spans(r.select("id", F.size("tokens").alias("n"), K.trainable(F.col("mask")).alias("weight")), "n", ["id"])
    return r.select("id", "start", "end", "weight")


def sampled_windows(spark, d):
    wp = _wordpiece(spark, d)
    r = W.encode_records(base(spark, d).where("size(segments) > 1"), wp).select("id", "tokens", "mask")
    w = K.sample_windows(r, 500, 64, 7, ["id"])
    return w.select("draw_id", "id", "start", F.size("x").alias("n"), F.size(F.filter("y", lambda t: t != -100)).alias("targets"))


def record_spans(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return K.spans(t, "n", ["doc_id"]).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def draw_lookup(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("w"))
    w = K.cumulative_weights(t, "w", ["doc_id"])
    total = F.broadcast(w.agg(F.max("hi").alias("total")))  # one row
    draws = table(spark, d, "orders").join(total, F.lit(True)).select("o_orderkey", (F.col("o_orderkey") * 1_000_003 % F.col("total")).alias("draw"))
    return K.draw_lookup(draws, "draw", w).select("o_orderkey", "draw", "doc_id")


def preference_pairs(spark, d):
    r = P.deliveries(table(spark, d, "training_records").where("size(rejected_segments) > 0"), "rejected_segments")
    r = r.select("id", "source", X.nfc_segments(F.col("segments")).alias("g"), X.nfc_segments(F.col("rejected_segments")).alias("b"))
    seg = lambda c: D.make_segments(F.col(c), clean=lambda x: X.clean_flat(x, False))
    r = r.select("id", "source", seg("g").alias("good"), seg("b").alias("bad"))
    out = R.preference_record(r, F.col("id"), X.name_key(F.col("source")), F.array().cast("array<struct<role:string,content:string,train:boolean>>"), F.col("good"), F.col("bad"))
    return out.select("id", "source", "task", F.size("segments").alias("n"), F.size("rejected_segments").alias("rejected"))


def canonical_records(spark, d):
    r = P.deliveries(table(spark, d, "training_records"), "task", "rejected_segments", "meta")
    out = R.make_record(r, F.col("id"), X.name_key(F.col("source")), F.col("segments"), F.col("meta"), F.col("task"), F.col("rejected_segments"))
    said = F.array_join(F.transform("segments", lambda x: F.concat(x["role"], F.lit(":"), x["content"], F.lit(":"), x["train"].cast("int").cast("string"))), "|")
    return out.select("schema", "id", "source", "task", F.size("segments").alias("n"), F.coalesce(F.size("rejected_segments"), F.lit(0)).alias("rejected"), F.sha2(said, 256).alias("digest"))


def raw_payloads(spark, d):
    raw = table(spark, d, "raw_records")
    p = R.parse_payloads(raw.where("line is not null"), "line", "raw_id")
    return p.select("raw_id", "kind", X.name_key(F.col("source")).alias("source"), F.size("segments").alias("n"))


def role_hist(spark, d):
    s = table(spark, d, "training_records").select(F.explode("segments").alias("s"))
    return s.groupBy(X.normalize_role(F.col("s.role")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def reply_tree_paths(spark, d):
    m = table(spark, d, "oasst1")
    p = TR.answer_paths(latest(m))
    text = F.array_join(F.transform("segments", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return p.select("leaf", "score", "n", F.sha2(text, 256).alias("digest"))


def latest(m: DataFrame) -> DataFrame:
    """The last delivery of each message; of several at one time the one with the largest hash, so that every run takes the same."""
    cols = [c for c in m.columns if c != "message_id"]
    last = F.max_by(F.struct(*cols), F.struct("ingested_at", F.xxhash64(*cols)))
    return m.groupBy("message_id").agg(last.alias("m")).select("message_id", "m.*")


def children_lists(spark, d):
    c = TR.children(latest(table(spark, d, "oasst1")))
    return c.select("parent_id", F.size("children").alias("n"), F.array_join("children", ",").alias("children"))


def line_id_join(spark, d):
    docs = table(spark, d, "documents")
    conv = docs.select(F.col("doc_id").alias("conv"), F.array(F.col("doc_id"), F.col("doc_id") + 7, F.col("doc_id") + 10_000_000, F.col("doc_id") + 3).alias("ids"))
    j = R.line_id_join(conv, "conv", "ids", docs.select(F.col("doc_id").alias("line"), "text"), "line", "text")
    roles = F.array_join(F.transform("segments", lambda s: F.substring(s["role"], 1, 1)), "")
    return j.select("conv", roles.alias("roles"), F.aggregate("segments", F.lit(0), lambda a, s: a + F.length(s["content"])).alias("chars"))


def persona_reset(spark, d):
    e = table(spark, d, "events")
    n = (F.col("event_id") % 5) + 1
    body = F.when(n == 1, F.concat(F.lit("your persona: "), F.col("event_type"))).otherwise(F.concat(F.lit("q "), F.col("event_id").cast("string"), F.lit("\t"), F.lit("a "), F.col("event_type")))
    lines = e.select((F.col("user_id") % 16).alias("file"), F.col("event_id").alias("line_no"), F.concat(n.cast("string"), F.lit(" "), body).alias("value"))
    return R.persona_conversations(lines).select("file", "conv", F.size("segments").alias("n"), F.size("persona").alias("personas"))


def speaker_roles(spark, d):
    e = table(spark, d, "events")
    s = R.speaker_roles(e, ["user_id"], "event_id", "event_type", "event_type")
    return s.select("user_id", F.array_join(F.transform("segments", lambda x: F.substring(x["role"], 1, 1)), "").alias("roles"))


def label_parse(spark, d):
    t = base(spark, d).select("id", D.render(F.col("segments")).alias("text"))
    p = R.parse_labels(t, ["id"], "text")
    return p.select("id", F.size("segments").alias("n"), F.sha2(F.array_join(F.transform("segments", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"), 256).alias("digest"))


def _paragraphs(text):
    """A text as paragraphs of a page, one for each of its parts between empty lines."""
    safe = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p>"))


def html_articles(spark, d):
    html = F.concat(F.lit("<html><body><p>"), F.repeat(F.lit("menu "), 20), F.lit("</p><h1 class='firstHeading'>"), F.coalesce("title", F.lit("")), F.lit("</h1><div class='mw-parser-output'>"), _paragraphs(F.col("text")), F.lit("</div></body></html>"))
    a = table(spark, d, "documents").select("doc_id", S.article_udf()(html).alias("a"))
    return a.select("doc_id", F.length("a.title").alias("title"), F.length("a.content").alias("chars"), F.sha2("a.content", 256).alias("digest"))


def news_articles(spark, d):
    """Pages whose body and decoy are marked in six ways, so that the order of the selectors decides."""
    kinds = [("article", "content"), ("div class='article-content'", "news-content"), ("div class='x news-content'", "content"), ("div class='content'", "x-news"), ("div class='my-article-box'", "x-news"), ("section class='latest-news'", "other")]
    k = F.col("doc_id") % len(kinds)
    head = F.when(k % 2 == 0, F.lit("<h1> Heading </h1>")).otherwise(F.lit("<title>Page</title>"))
    decoy, opened, closed = F.lit(""), F.lit(""), F.lit("")
    for i, (body, other) in enumerate(kinds):
        decoy = F.when(k == i, F.lit(f"<div class='{other}'><p>{'d' * 40}</p></div>")).otherwise(decoy)
        opened, closed = F.when(k == i, F.lit(f"<{body}>")).otherwise(opened), F.when(k == i, F.lit(f"</{body.split()[0]}>")).otherwise(closed)
    html = F.concat(head, decoy, opened, _paragraphs(F.col("text")), closed)
    a = table(spark, d, "documents").select("doc_id", S.news_udf()(html).alias("a"))
    return a.select("doc_id", F.col("a.title").alias("title"), F.length("a.content").alias("chars"), F.sha2("a.content", 256).alias("digest"))


def category_accuracy(spark, d):
    docs = table(spark, d, "documents").select(X.name_key(F.col("category")).alias("label"), X.name_key(F.col("source")).alias("predicted"))
    return M.accuracy(docs.select(F.when(F.col("label") != "", F.col("label")).alias("label"), F.when(F.col("predicted") != "", F.col("predicted")).alias("predicted")), "label", "predicted").select("n", F.round("accuracy", 6).alias("accuracy"))


def crawl_metadata(spark, d):
    r = K2.crawl_metadata(table(spark, d, "documents"))
    return r.select("total", F.array_join("categories", ",").alias("categories"), F.array_join("sources", ",").alias("sources"))


def char_stats(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(X.name_key(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(F.length("text") >= 200).alias("long"))


def regression_errors(spark, d):
    e = M.errors(table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("p")), "y", "p")
    return e.select(F.round("mae", 6).alias("mae"), F.round("sae", 2).alias("sae"), F.round("mse", 4).alias("mse"))


def masked_loss(spark, d):
    e = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.when(F.col("vec_id") % 3 == 0, -100).otherwise(F.col("label") % 10).cast("int").alias("gold"))
    m = M.masked_loss(e, "logits", "gold", smoothing=0.1)
    mixed = M.objective_loss("ce_dft", F.col("smoothed"), F.col("dft"), N.ramp(F.lit(300), 100, 1100))
    return m.select(*[F.round(c, 6).alias(c) for c in ("loss", "smoothed", "dft", "gold_prob")], F.round(mixed, 6).alias("mixed"), "valid")


def eval_means(spark, d):
    """Losses of batches of 50 vectors, then the means over the batches."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("batch"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.when(F.col("vec_id") % 3 == 0, -100).otherwise(F.col("label") % 10).cast("int").alias("gold"))
    m = M.mean_metrics(M.masked_loss(e, "logits", "gold", by=["batch"]), ["loss", "dft", "gold_prob"])
    return m.select(*[F.round(c, 6).alias(c) for c in ("loss", "dft", "gold_prob")], "batches")


def scatter_add(spark, d):
    r = M.scatter_add(table(spark, d, "lineitem"), "l_linenumber", "l_quantity")
    return r.select("l_linenumber", F.round("total", 2).alias("total"))


def embedding_gather(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(v.agg((F.max("vec_id") + 2).alias("n")))  # one row; the last id is unknown
    t = table(spark, d, "orders").join(n, F.lit(True)).select(F.col("o_orderkey").alias("key"), F.array(F.col("o_orderkey") % F.col("n"), F.col("o_custkey") % F.col("n")).alias("ids"))
    g = M.gather_embeddings(t, "key", "ids", v, "vec_id", "embedding", 2.0)
    return g.select("key", "pos", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


def learning_rates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    s = F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.round(N.warmup_cosine(s, 0.01, 1000, 12000, 0.001), 9).alias("cosine"), F.round(N.inverse_sqrt(s, 512, 4000), 9).alias("inverse"),
        F.round(N.step_decay(s, 0.1, 3000, 0.5), 9).alias("decay"), F.round(N.ramp(s, 100, 1100), 9).alias("alpha"),
    )


def numbered_ids(spark, d):
    return U.number(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "row-%07d", ["c_mktsegment", "c_custkey"])


def full_batches(spark, d):
    b = U.full_batches(table(spark, d, "orders").select("o_orderkey"), 64, ["o_orderkey"])
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


def value_ema(spark, d):
    e = M.ema_by(table(spark, d, "events"), "user_id", ["event_id"], "value")
    return e.select("user_id", F.round("ema", 6).alias("ema"))


def softmax_draws(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("l"))
    p = N.softmax(N.top_k_mask(F.col("l"), 5), 0.7)
    u = K.draw(3, "vec_id", F.lit(1_000_000)) / 1e6
    return e.select("vec_id", M.draw_index(p, u).alias("drawn"), (F.array_position("l", F.array_max("l")) - 1).cast("int").alias("best"))


def token_set_algebra(spark, d):
    w = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    p = table(spark, d, "part")
    a, b = w(F.col("p_name")), w(F.col("p_type"))
    show = lambda x: F.array_join(F.array_sort(x), " ")
    return p.select("p_partkey", show(F.array_union(a, b)).alias("both"), show(F.array_intersect(a, b)).alias("shared"), show(F.array_except(a, b)).alias("own"))


def tightened_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_chinese(F.col("text")).alias("t")).select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("chars"))


def cleaned_text(spark, d):
    """Digests of every cleaner over all documents."""
    clean = {"lines": X.clean_lines, "flat": X.clean_flat, "each_line": X.clean_each_line, "normal": X.normalize_text}
    return table(spark, d, "documents").select("doc_id", *[F.sha2(f(F.col("text")), 256).alias(n) for n, f in clean.items()])


def first_paragraphs(spark, d):
    """The long ones of the first five paragraphs."""
    p = F.transform(F.slice(F.split(X.unify_newlines(F.col("text")), "\n\n"), 1, 5), X.strip)
    long = F.filter(p, lambda x: F.length(x) > 50)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(long).alias("n"), F.aggregate(long, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


def trimmed_dialogs(spark, d):
    t = base(spark, d).select("id", D.trim_budget(F.col("segments"), 4, 600).alias("s"))
    return t.select("id", F.size("s").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x["content"])).alias("chars"))


def _quality(spark, d):
    cfg = P.BuildConfig(max_turns=8, flat=True, quota=200, max_total=1_000_000, bounds=TOKEN_BOUNDS, id_pattern="quality-%07d")
    return P.build(table(spark, d, "training_records"), cfg, _wordpiece(spark, d))


def quality_build(spark, d):
    """The whole build with a tokenizer's bounds and quotas: its records."""
    r, _ = _quality(spark, d)
    return r.select("id", "source", "task", F.size("segments").alias("n"), F.get_json_object("meta", "$.record_tokens").cast("int").alias("record_tokens"), F.get_json_object("meta", "$.response_tokens").cast("int").alias("response_tokens"))


def quality_stats(spark, d):
    """The same build's statistics per source; reasons as text."""
    _, s = _quality(spark, d)
    reasons = F.coalesce(F.array_join(F.transform(F.map_entries("skip_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","), F.lit(""))
    return s.select("source", "scanned", "candidates", "written", "duplicates", "skipped", *P.TOKEN_SUMS, reasons.alias("reasons"), (F.col("written_chars") > 0).alias("has_chars"))


def merge_corpora(spark, d):
    """Every source of source_specs as a corpus, rows of all other sources as the corpus `rest`, and the first one again."""
    r = cut_lineage(P.deliveries(table(spark, d, "training_records")).select("source", "segments"))
    key = X.name_key(F.col("source"))
    known = {x["k"] for x in table(spark, d, "source_specs").select(X.name_key(F.col("name")).alias("k")).collect()} - {""}
    first = ["worldtalk", "lanternchat", "smalltalkzh"]
    names = [*first, *sorted(known - set(first))]
    parts = [(s, r.where(key == s)) for s in names]
    _, stats = P.merge_corpora([*parts, ("rest", r.where(~key.isin(names))), ("again", parts[0][1])])
    return stats


def chat_mix(spark, d):
    r = P.deliveries(table(spark, d, "training_records"))
    named = {"lanternchat": 150, "feedbacknotes": 100}
    key = X.name_key(F.col("source"))
    parts = [(s, r.where(key == s), q) for s, q in named.items()] + [("rest", r.where(~key.isin(*named)), 1_000_000)]
    return P.chat_mix(parts).select("source_name", "id", F.size("segments").alias("n"), "rank")


def reasoning_examples(spark, d):
    return G.reasoning_records(spark, 1000, 0).select("id", "source", "task", F.get_json_object("meta", "$.task").alias("kind"), F.get("segments", F.lit(0))["content"].alias("input"), F.get_json_object("meta", "$.answer").alias("answer"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            dialog_segments, prefix_windows, context_windows_2_4_6, sliding_window_3, single_turn_pairs, short_dialogs, full_dialog, prompt_dedup_first_valid, dedup_counters,
            skip_reason_hist, daily_reason_hist, chinese_reason_hist, logic_reason_hist, source_quota, merge_fold, english_ratio, cjk_ratio, bad_prompts, language_gate, message_filter,
            text_records, char_budget, doc_chunks, word_freq_topk, vocab_prune, token_counts, packed_records, sampled_windows, record_spans, draw_lookup, preference_pairs,
            canonical_records, raw_payloads, role_hist, reply_tree_paths, children_lists, line_id_join, persona_reset, speaker_roles, label_parse, html_articles, news_articles, category_accuracy,
            crawl_metadata, char_stats, regression_errors, masked_loss, eval_means, scatter_add, embedding_gather, learning_rates, numbered_ids, full_batches, value_ema, softmax_draws,
            token_set_algebra, tightened_text, cleaned_text, first_paragraphs, trimmed_dialogs, quality_build, quality_stats, merge_corpora, chat_mix, reasoning_examples,
        )
    }

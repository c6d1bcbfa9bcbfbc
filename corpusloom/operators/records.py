"""Canonical records from payloads of other shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dialog import segment, truncate_chars
from corpusloom.schema import ROLES, SCHEMA_TAG, SEGMENTS_DDL


def _empty() -> Column:
    return F.array().cast(SEGMENTS_DDL)


def serialize(segments: Column, compose: bool = True) -> Column:
    """Canonical segments: roles by alias, contents normalised, empty ones left out; an unknown role raises an error.

    `compose=False` is for segments composed before.
    """

    def one(s: Column) -> Column:
        role = X.normalize_role(F.coalesce(s["role"], F.lit("text")))
        checked = F.when(role.isin(*ROLES), role).otherwise(F.raise_error(F.concat(F.lit("unsupported role "), role)))
        return segment(checked, X.normalize_text(F.coalesce(s["content"], F.lit("")), False), F.coalesce(s["train"], X.default_train(role)))

    ready = X.nfc_segments(segments) if compose else segments
    return F.filter(F.transform(F.coalesce(ready, _empty()), one), lambda s: s["content"] != "")


def make_record(df: DataFrame, record_id: Column, source: Column, segments: Column, meta: Column | None = None, task: Column | None = None, rejected: Column | None = None, compose: bool = True) -> DataFrame:
    """The canonical record's columns; `rejected_segments` is null when there are none."""
    none = F.lit(None).cast("string")
    r = _empty() if rejected is None else serialize(rejected, compose)
    s = df.select(record_id.alias("id"), source.alias("source"), serialize(segments, compose).alias("segments"), r.alias("r"), (none if meta is None else meta).alias("meta"), (none if task is None else task).alias("t"))
    return s.select(
        F.lit(SCHEMA_TAG).alias("schema"), "id", "source", X.normalize_task(F.col("t"), F.col("segments"), F.col("r")).alias("task"),
        "segments", F.when(F.size("r") > 0, F.col("r")).alias("rejected_segments"), F.coalesce("meta", F.lit("{}")).alias("meta"),
    )


def from_messages(messages: Column) -> Column:
    """Messages with role|from and content|value|text → segments of the three speaking roles, blanks left out."""
    s = F.transform(X.nfc_segments(messages), lambda m: segment(X.normalize_role(m["role"]), X.normalize_text(F.coalesce(m["content"], F.lit("")), False)))
    return F.filter(s, lambda x: x["role"].isin("system", "user", "assistant") & (x["content"] != ""))


def from_instruction(instruction: Column, answer: Column, context: Column | None = None, mark: str = "\n") -> Column:
    """Instruction, with its context after `mark` if there is any, and answer; empty if either is blank."""
    clean = lambda c: X.normalize_text(F.coalesce(c, F.lit("")))
    q, a = clean(instruction), clean(answer)
    x = F.lit("") if context is None else clean(context)
    user = F.when(x == "", q).otherwise(F.concat(q, F.lit(mark), x))
    return F.when((q != "") & (a != ""), F.array(segment(F.lit("user"), user), segment(F.lit("assistant"), a))).otherwise(_empty())


def dolly(instruction: Column, context: Column, response: Column) -> Column:
    return from_instruction(instruction, response, context, "\n\nContext:\n")


def preference_branch(prompt: Column, response: Column) -> Column:
    """The prompt before the response, unless the response brings its own."""
    own = F.coalesce(F.get(response, F.lit(0))["role"].isin("system", "user"), F.lit(False))
    return F.when((F.size(prompt) == 0) | own, response).otherwise(F.concat(prompt, response))


def preference_record(df: DataFrame, record_id: Column, source: Column, prompt: Column, chosen: Column, rejected: Column, max_chars: int | None = None) -> DataFrame:
    """Preference records; rows of which either branch is empty are left out."""
    good, bad = preference_branch(prompt, chosen), preference_branch(prompt, rejected)
    if max_chars is not None:
        good, bad = truncate_chars(good, max_chars), truncate_chars(bad, max_chars)
    d = df.withColumn("_good", good).withColumn("_bad", bad).where((F.size("_good") > 0) & (F.size("_bad") > 0))
    return make_record(d, record_id, source, F.col("_good"), task=F.lit("preference"), rejected=F.col("_bad"))


LABEL = r"^(?i:(用户|User|Human)|(系统|System)|(助手|Assistant))\s*[：:]\s*(.*)$"


def parse_labels(df: DataFrame, key: list[str], text: str, out: str = "segments") -> DataFrame:
    """Texts with role labels at line starts → segments; lines without a label continue the turn before.

    Lines before the first label are dropped.  The fold stays within the row.
    """
    return df.select(*key, labelled_turns(F.col(text)).alias(out))


def labelled_turns(text: Column) -> Column:
    """The turns of one text with role labels, as an array of segments."""
    lines = F.split(X.unify_newlines(X.strip_special_tokens(F.coalesce(text, F.lit("")))), r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")

    def step(acc: Column, line: Column) -> Column:
        hit = line.rlike(LABEL)
        role = F.when(F.regexp_extract(line, LABEL, 1) != "", "user").when(F.regexp_extract(line, LABEL, 2) != "", "system").otherwise("assistant")
        last = F.try_element_at(acc, F.lit(-1))
        grown = segment(last["role"], F.concat(last["content"], F.lit("\n"), line), last["train"])
        body = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(hit, F.concat(acc, F.array(segment(role, F.regexp_extract(line, LABEL, 4))))).when(F.size(acc) > 0, F.concat(body, F.array(grown))).otherwise(acc)

    turns = F.aggregate(lines, _empty(), step)
    return F.filter(F.transform(turns, lambda s: segment(s["role"], X.strip(s["content"]), s["train"])), lambda s: s["content"] != "")


def text_segments(text: Column, labels: bool = False) -> Column:
    """One text segment, or none.

    With `labels`, a text whose lines carry role labels becomes their turns, if a user
    or an assistant is among them.
    """
    t = X.strip_special_tokens(X.normalize_text(F.coalesce(text, F.lit(""))))
    whole = F.when(t != "", F.array(segment(F.lit("text"), t))).otherwise(_empty())
    if not labels:
        return whole
    turns = labelled_turns(t)
    return F.when(F.exists(turns, lambda s: s["role"].isin("user", "assistant")), turns).otherwise(whole)


def user_labels(text: Column) -> Column:
    """'User 1:' and 'User 2:' lines, in any letter case → alternating speakers; other lines are dropped."""
    label = r"(?i)^User\s*([12])\s*:\s*(.*)$"
    lines = F.transform(F.split(X.unify_newlines(F.coalesce(text, F.lit(""))), r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), X.strip)
    said = F.filter(lines, lambda x: x.rlike(label))
    return F.filter(F.transform(said, lambda x: segment(F.when(F.regexp_extract(x, label, 1) == "1", "user").otherwise("assistant"), X.strip(F.regexp_extract(x, label, 2)))), lambda s: s["content"] != "")


def payload_kind(payload: Column) -> Column:
    """Shape of a JSON payload by the keys present: canonical, preference, messages, conversations, instruction, text or scalar.

    A key that is present counts even if its value is null.
    """
    v = X.json_value(payload)
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    return (
        F.when(v.isNull(), "invalid").when(~F.schema_of_variant(v).startswith("OBJECT"), "scalar").when(F.get_json_object(payload, "$.schema") == SCHEMA_TAG, "canonical")
        .when(has("chosen") & has("rejected"), "preference").when(has("messages"), "messages").when(has("conversations"), "conversations")
        .when(has("input") & has("output"), "instruction").when(has("text"), "text").otherwise("other")
    )


def first_present(payload: Column, keys: list[str]) -> Column:
    """JSON text of the first of some keys that is present; a present null gives null."""
    have = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.array_contains(have, k), F.get_json_object(payload, f"$.{k}")).otherwise(out)
    return out


def segment_list(payload: Column, keys: list[str], strict: bool) -> Column:
    """Segments under the first present of some keys; a value that is no list is null, or an error if `strict`."""
    raw = first_present(payload, keys)
    segs = F.from_json(raw, "array<struct<role string, content string, train boolean>>")
    if not strict:
        return segs
    bad = raw.isNotNull() & ~X.strip(raw).startswith("[")
    return F.when(bad, F.raise_error(F.lit("segments must be a list")).cast(SEGMENTS_DDL)).otherwise(segs)


def parse_payloads(df: DataFrame, payload: str, key: str, strict: bool = False) -> DataFrame:
    """(key, kind, source, segments, rejected) of JSON payloads of any supported shape.

    With `strict`, segments that are no list, payloads of an unknown shape, canonical
    records of other roles and records without any text are errors; else they give
    empty segments or, for roles, leave the segment out.
    """
    p = F.col(payload)
    seg = segment_list(p, ["segments", "messages", "chosen_segments", "chosen"], strict)
    rej = segment_list(p, ["rejected_segments", "rejected"], strict)
    conv = F.transform(F.from_json(F.get_json_object(p, "$.conversations"), "array<struct<`from`: string, `value`: string, role: string, content: string>>"), lambda m: segment(F.coalesce(m["from"], m["role"]), F.coalesce(m["value"], m["content"])))
    kind = payload_kind(p)
    ready = (lambda x: serialize(x)) if strict else serializable
    j = lambda k: F.get_json_object(p, f"$.{k}")
    s = (
        F.when(kind.isin("canonical", "messages", "preference"), ready(seg)).when(kind == "conversations", from_messages(conv))
        .when(kind == "instruction", from_instruction(F.coalesce(j("instruction"), j("input")), j("output"))).when(kind == "text", text_segments(j("text"))).when(kind == "scalar", text_segments(F.from_json(F.concat(F.lit('{"v":'), p, F.lit("}")), "v string")["v"]))
        .otherwise(_empty())
    )
    if strict:
        s = F.when(F.size(s) == 0, F.raise_error(F.concat(F.lit("no text in payload "), F.col(key).cast("string"))).cast(SEGMENTS_DDL)).otherwise(s)
    return df.select(key, kind.alias("kind"), F.when(kind != "invalid", j("source")).alias("source"), s.alias("segments"), ready(rej).alias("rejected"))


def serializable(segments: Column) -> Column:
    """As `serialize`, leaving segments of unknown roles out instead of failing."""
    known = F.filter(F.coalesce(segments, _empty()), lambda s: X.normalize_role(F.coalesce(s["role"], F.lit("text"))).isin(*ROLES))
    return serialize(known)


def chunk_paragraphs(text: Column, size: int) -> Column:
    """Greedy chunks of whole paragraphs up to `size` characters; longer paragraphs are cut hard.

    A paragraph above the size first closes the open chunk.
    """
    t = X.strip_special_tokens(X.normalize_text(F.coalesce(text, F.lit(""))))
    paragraphs = F.filter(F.transform(F.split(t, "\n\n"), X.strip), lambda p: p != "")
    init = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def pieces(p: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(size)), lambda i: X.strip(F.substring(p, i + 1, F.lit(size))))
        return F.filter(cuts, lambda x: x != "")

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 2 + F.length(p) <= size)
        closed = F.when(fits | (acc["open"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))
        left = F.when(fits, acc["open"]).otherwise("")
        grown = F.when(left == "", p).otherwise(F.concat(left, F.lit("\n\n"), p))
        long = F.length(p) > size
        return F.struct(F.when(long, left).otherwise(grown).alias("open"), F.when(long, F.concat(closed, pieces(p))).otherwise(closed).alias("out"))

    return F.aggregate(paragraphs, init, step, lambda a: F.when(a["open"] != "", F.concat(a["out"], F.array(a["open"]))).otherwise(a["out"]))


def persona_conversations(lines: DataFrame, order: str = "line_no", text: str = "value", file: str = "file") -> DataFrame:
    """(file, conv, segments, persona) of a numbered chat log: 'N user<TAB>assistant', where N = 1 starts a conversation.

    The log is ordered within its file; a file is the unit of order, so it should be
    no larger than one task can sort.
    """
    w = Window.partitionBy(file).orderBy(order)
    n = F.regexp_extract(text, r"^(\d+) ", 1)
    body = F.regexp_replace(F.col(text), r"^\d+ ", "")
    marked = lines.where(n != "").withColumn("conv", F.sum((n == "1").cast("int")).over(w)).withColumn("body", body)
    turn = F.split("body", "\t")
    said = marked.where(~F.lower("body").rlike("^(your|partner's) persona:") & (F.size(turn) > 1)).withColumn("pair", F.array(segment(F.lit("user"), X.strip(F.get(turn, F.lit(0)))), segment(F.lit("assistant"), X.strip(F.get(turn, F.lit(1))))))
    persona = marked.where(F.lower("body").rlike("^(your|partner's) persona:")).groupBy(file, "conv").agg(F.array_sort(F.collect_list(F.struct(order, X.strip(F.regexp_replace("body", "^[^:]*:", "")).alias("p")))).alias("ps"))
    talks = said.groupBy(file, "conv").agg(F.array_sort(F.collect_list(F.struct(order, "pair"))).alias("ts"))
    return talks.join(persona, [file, "conv"], "left").select(file, "conv", F.flatten(F.transform("ts", lambda t: t["pair"])).alias("segments"), F.coalesce(F.transform("ps", lambda x: x["p"]), F.array().cast("array<string>")).alias("persona"))


def speaker_roles(df: DataFrame, conv: list[str], idx: str, speaker: str, text: str) -> DataFrame:
    """(conv…, segments): utterances in numeric order; the first speaker is the user, every other the assistant."""
    turns = df.groupBy(*conv).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).cast("int").alias("i"), F.col(speaker).alias("who"), F.col(text).alias("said")))).alias("t"))
    first = F.get(F.col("t"), F.lit(0))["who"]
    return turns.select(*conv, F.transform("t", lambda x: segment(F.when(x["who"].eqNullSafe(first), "user").otherwise("assistant"), F.coalesce(x["said"], F.lit("")))).alias("segments"))


def line_id_join(conversations: DataFrame, conv: str, ids: str, lines: DataFrame, line: str, text: str, order: str | None = None) -> DataFrame:
    """(conv, segments): conversations given as lists of line ids joined to their lines.

    Unknown lines are blank: they keep the parity of the speakers and are then
    dropped.  Of repeated line ids the last by `order` counts, ties by text; without
    `order`, line ids must be unique.
    """
    last = lines.groupBy(line).agg(F.max(F.struct(*([order] if order else []), text)).alias("_l")).select(line, F.col(f"_l.{text}").alias("_text"))
    ids_ = conversations.select(conv, F.posexplode(ids).alias("pos", line))
    j = ids_.join(last, line, "left")
    t = j.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_text", F.lit("")).alias("said")))).alias("t"))
    s = F.transform("t", lambda x: segment(F.when(x["pos"] % 2 == 0, "user").otherwise("assistant"), x["said"]))
    return t.select(conv, F.filter(s, lambda x: X.strip(x["content"]) != "").alias("segments"))


def paired_utterances(first: Column, second: Column) -> Column:
    """Two arrays of turns, zipped to the shorter one: users and assistants by turns, blanks left out."""
    n = F.least(F.size(F.coalesce(first, F.array().cast("array<string>"))), F.size(F.coalesce(second, F.array().cast("array<string>"))))
    a, b = F.slice(first, F.lit(1), n), F.slice(second, F.lit(1), n)
    both = F.zip_with(a, b, lambda x, y: F.array(segment(F.lit("user"), F.coalesce(x, F.lit(""))), segment(F.lit("assistant"), F.coalesce(y, F.lit("")))))
    return F.filter(F.flatten(both), lambda s: X.strip(s["content"]) != "")


def label_turns(segments: Column, max_chars: int) -> Column:
    """Labelled text of the turns up to the first blank one or the budget; '' without an answer or with fewer than two turns."""
    init = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("answers"), F.lit(False).alias("stop"))

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["role"] == "user", "User").when(s["role"] == "assistant", "Assistant")
        line = F.concat(label, F.lit(": "), X.strip(s["content"]))
        grown = F.when(acc["text"] == "", line).otherwise(F.concat(acc["text"], F.lit("\n"), line))
        stop = acc["stop"] | label.isNull() | (X.strip(s["content"]) == "") | (F.length(grown) > max_chars)
        add = ~F.coalesce(stop, F.lit(True))
        return F.struct(
            F.when(add, grown).otherwise(acc["text"]).alias("text"), F.when(add, acc["n"] + 1).otherwise(acc["n"]).cast("int").alias("n"),
            F.when(add & (s["role"] == "assistant"), acc["answers"] + 1).otherwise(acc["answers"]).cast("int").alias("answers"), F.coalesce(stop, F.lit(True)).alias("stop"),
        )

    return F.aggregate(segments, init, step, lambda a: F.when((a["answers"] > 0) & (a["n"] > 1), a["text"]).otherwise(""))

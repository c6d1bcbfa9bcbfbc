"""Dialogues as arrays of segments: cleaning, merging, windows, rendering.

Everything works inside the row by higher-order functions; only the window
operators turn one row into several, and none needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.numeric import let
from corpusloom.schema import ROLE_LABELS, SEGMENTS_DDL


def segment(role: Column, content: Column, train: Column | None = None) -> Column:
    t = X.default_train(role) if train is None else train
    return F.struct(role.alias("role"), content.alias("content"), t.alias("train"))


def make_segments(
    segments: Column,
    clean: Callable[[Column], Column] = X.clean_lines,
    roles: tuple[str, ...] = ("system", "user", "assistant"),
    keep: Callable[[Column], Column] | None = None,
    keep_train: bool = False,
    dialog_roles: bool = False,
) -> Column:
    """Canonical roles, cleaned contents; segments of other roles, empty ones or ones failing `keep` are left out.

    `train` follows the role unless `keep_train` (then null follows the role).  A
    null array stays null.
    """

    def one(s: Column) -> Column:
        role = X.normalize_role(s["role"], dialog_roles)
        train = F.coalesce(s["train"], X.default_train(role)) if keep_train else role == "assistant"
        return segment(role, clean(F.coalesce(s["content"], F.lit(""))), train)

    out = F.filter(F.transform(segments, one), lambda s: s["role"].isin(*roles) & (s["content"] != ""))
    return out if keep is None else F.filter(out, lambda s: keep(s["content"]))


def merge_adjacent(segments: Column, merge_system: bool = True, or_train: bool = False) -> Column:
    """Merge neighbours of the same role with a line break.

    Without `merge_system` system segments stay apart.  With `or_train` a merged
    segment trains if one of its parts does, else as its last part.
    """

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (last["role"] == s["role"]) & (F.lit(True) if merge_system else s["role"] != "system")
        train = (last["train"] | s["train"]) if or_train else s["train"]
        merged = segment(s["role"], F.concat(last["content"], F.lit("\n"), s["content"]), train)
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(segments, F.array().cast(SEGMENTS_DDL), step)


def compact(segments: Column, **kw) -> Column:
    """`make_segments`, then `merge_adjacent`."""
    merge = {k: kw.pop(k) for k in ("merge_system", "or_train") if k in kw}
    return merge_adjacent(make_segments(segments, **kw), **merge)


def last_index(segments: Column, role: str) -> Column:
    """Place of the last segment of a role, -1 if there is none."""
    return F.coalesce(F.array_max(F.transform(segments, lambda s, i: F.when(s["role"] == role, i))), F.lit(-1))


def first_index(segments: Column, cond: Callable[[Column], Column]) -> Column:
    """Place of the first segment that meets a condition; the size if there is none."""
    return let(segments, lambda v: F.coalesce(F.array_min(F.transform(v, lambda s, i: F.when(cond(s), i))), F.size(v)))


def retarget_last_assistant(segments: Column) -> Column:
    """Only the last assistant segment trains."""

    def body(v: Column) -> Column:
        return let(last_index(v, "assistant"), lambda last: F.transform(v, lambda s, i: segment(s["role"], s["content"], (s["role"] == "assistant") & (i == last))))

    return let(segments, body)


def turn_count(segments: Column) -> Column:
    return F.size(F.filter(segments, lambda s: s["role"].isin("user", "assistant")))


def has_role(segments: Column, role: str) -> Column:
    return F.exists(segments, lambda s: s["role"] == role)


def split_system(df: DataFrame, col: str = "segments", system: str = "system", dialog: str = "dialog") -> DataFrame:
    """Add the leading system segments, and the user and assistant rest trimmed to begin with a user and end with an assistant."""
    s = F.col(col)
    n = first_index(s, lambda x: x["role"] != "system")
    rest = F.filter(F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))), lambda x: x["role"].isin("user", "assistant"))
    df = df.withColumn(system, F.slice(s, F.lit(1), n)).withColumn("_rest", rest)
    r = F.col("_rest")
    a, b = first_index(r, lambda x: x["role"] == "user"), last_index(r, "assistant")
    return df.withColumn(dialog, F.when(b > a, F.slice(r, a + 1, b - a + 1)).otherwise(F.array().cast(SEGMENTS_DDL))).drop("_rest")


def targets(df: DataFrame, col: str = "segments") -> DataFrame:
    """One row per assistant segment, its place in `turn`; dialogues without any vanish."""
    at = F.filter(F.transform(F.col(col), lambda s, i: F.when(s["role"] == "assistant", i)), lambda i: i.isNotNull())
    return df.withColumn("turn", F.explode(at))


def prefix_windows(df: DataFrame, max_turns: int = 0, col: str = "segments", need_user: bool = True) -> DataFrame:
    """One window per assistant segment: all up to it; windows above `max_turns` turns (0: no bound) are dropped."""
    w = targets(df, col).withColumn("window", retarget_last_assistant(F.slice(F.col(col), F.lit(1), F.col("turn") + 1)))
    if max_turns > 0:
        w = w.where(turn_count(F.col("window")) <= max_turns)
    return w.where(has_role(F.col("window"), "user")) if need_user else w


def context_windows(df: DataFrame, sizes: list[int], col: str = "segments", prefix: str | None = None) -> DataFrame:
    """A window of at most `size` segments up to each assistant segment, for each size.

    A window advances past assistant segments at its start.  Early targets give the
    same window for several sizes.  `prefix` names segments put before each window.
    """
    sizes = sorted({x for x in sizes if x > 1})
    w = targets(df, col).withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes])))
    s, i = F.col(col), F.col("turn")
    start = F.greatest(F.lit(0), i - F.col("size") + 1)
    cut = F.slice(s, start + 1, i - start + 1)
    w = w.withColumn("window", retarget_last_assistant(let(cut, drop_leading_answers))).where(F.size("window") > 0)
    return w if prefix is None else w.withColumn("window", F.concat(F.col(prefix), "window"))


def drop_leading_answers(segments: Column) -> Column:
    """Without the assistant segments at the start."""
    return let(first_index(segments, lambda x: x["role"] != "assistant"), lambda n: F.slice(segments, n + 1, F.greatest(F.size(segments) - n, F.lit(0))))


def single_turns(df: DataFrame, col: str = "segments", prefix: str | None = None) -> DataFrame:
    """Each assistant segment with the user segment directly before it."""
    w = targets(df, col).where((F.col("turn") > 0) & (F.get(F.col(col), F.col("turn") - 1)["role"] == "user"))
    w = w.withColumn("window", retarget_last_assistant(F.slice(F.col(col), F.col("turn"), F.lit(2))))
    return w if prefix is None else w.withColumn("window", F.concat(F.col(prefix), "window"))


def full_dialog(segments: Column) -> Column:
    """All assistant segments train."""
    return F.transform(segments, lambda s: segment(s["role"], s["content"], s["role"] == "assistant"))


def expand(df: DataFrame, mode: str, sizes: list[int] | None = None, col: str = "segments") -> DataFrame:
    """Windows in one of the modes full, prefix, single_turn and window, each after the leading system segments."""
    d = split_system(df, col)
    if mode == "full":
        out = d.where(F.size("dialog") > 0).withColumn("turn", F.size("dialog") - 1).withColumn("window", F.concat("system", full_dialog(F.col("dialog"))))
    elif mode == "prefix":
        out = prefix_windows(d, col="dialog").withColumn("window", F.concat("system", "window"))
    elif mode == "single_turn":
        out = single_turns(d, "dialog", "system")
    elif mode == "window":
        out = context_windows(d, sizes or [2, 4, 6], "dialog", "system")
    else:
        raise ValueError("mode must be full, prefix, single_turn or window")
    return out.drop("system", "dialog")


def render_segment(s: Column) -> Column:
    """'Label: content' and a line break; text segments raw."""
    label = reduce(lambda a, kv: a.when(s["role"] == kv[0], F.lit(kv[1])), ROLE_LABELS.items(), F.when(F.lit(False), ""))
    return F.when(s["role"] == "text", s["content"]).otherwise(F.concat(label, F.lit(": "), s["content"], F.lit("\n")))


def render(segments: Column, only: Callable[[Column], Column] | None = None) -> Column:
    s = segments if only is None else F.filter(segments, only)
    return X.strip(F.array_join(F.transform(s, render_segment), ""))


def flat_lower(c: Column) -> Column:
    return X.collapse_space(F.lower(c))


def prompt_key(segments: Column) -> Column:
    """SHA-256 of role and flat lower-case content of the segments that don't train."""
    return F.sha2(F.array_join(F.transform(F.filter(segments, lambda s: ~s["train"]), lambda s: F.concat(s["role"], F.lit(":"), flat_lower(s["content"]))), "\n"), 256)


def record_key(segments: Column, raw: bool = False, with_train: bool = True, roles: tuple[str, ...] | None = None) -> Column:
    """SHA-256 of role, content (`raw`: as it is) and train flag of all segments, or of those of some roles."""
    s = segments if roles is None else F.filter(segments, lambda x: x["role"].isin(*roles))

    def one(x: Column) -> Column:
        content = x["content"] if raw else flat_lower(x["content"])
        parts = [x["role"], F.lit(":"), content]
        if with_train:
            parts += [F.lit(":"), x["train"].cast("int").cast("string")]
        return F.concat(*parts)

    return F.sha2(F.array_join(F.transform(s, one), "\n"), 256)


def truncate_chars(segments: Column, max_chars: int) -> Column:
    """Cut segments to a character budget: each to what is left, right-trimmed; the budget counts what stays."""
    init = F.struct(F.lit(0).alias("used"), F.array().cast(SEGMENTS_DDL).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        content = X.rstrip(F.substring(s["content"], F.lit(1), F.greatest(F.lit(max_chars) - acc["used"], F.lit(0))))
        add = (acc["used"] < max_chars) & (content != "")
        return F.struct(
            F.when(add, acc["used"] + F.length(content)).otherwise(acc["used"]).cast("int").alias("used"),
            F.when(add, F.concat(acc["out"], F.array(segment(s["role"], content, s["train"])))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(segments, init, step, lambda a: a["out"])


def trim_budget(segments: Column, max_turns: int, max_chars: int) -> Column:
    """Keep segments while turns and characters last; then drop ends that aren't answers and leading answers.

    A first segment above the budget is skipped; a later one ends the record.
    """
    init = F.struct(F.lit(0).alias("used"), F.lit(0).alias("turns"), F.lit(False).alias("stop"), F.array().cast(SEGMENTS_DDL).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        is_turn = s["role"].isin("user", "assistant")
        over = acc["used"] + F.length(s["content"]) > max_chars
        stop = acc["stop"] | (is_turn & (acc["turns"] >= max_turns)) | (over & (F.size(acc["out"]) > 0))
        add = ~stop & ~over
        return F.struct(
            F.when(add, acc["used"] + F.length(s["content"])).otherwise(acc["used"]).cast("int").alias("used"),
            F.when(add & is_turn, acc["turns"] + 1).otherwise(acc["turns"]).cast("int").alias("turns"),
            stop.alias("stop"),
            F.when(add, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
        )

    kept = F.aggregate(segments, init, step, lambda a: a["out"])
    head = let(kept, lambda k: F.slice(k, F.lit(1), last_index(k, "assistant") + 1))
    return let(head, drop_leading_answers)


def alternating(turns: Column, first: str = "user") -> Column:
    """Texts → segments whose roles alternate by place; blank texts are dropped afterwards, so parity stays."""
    other = "assistant" if first == "user" else "user"
    s = F.transform(turns, lambda t, i: segment(F.when(i % 2 == 0, first).otherwise(other), F.coalesce(t, F.lit(""))))
    return F.filter(s, lambda x: X.strip(x["content"]) != "")


def loss_enabled(s: Column, mode: str) -> Column:
    """Whether a segment trains under a loss mode: all, assistant or record."""
    if mode not in ("all", "assistant", "record"):
        raise ValueError("loss mode must be record, assistant or all")
    return {"all": F.lit(True), "assistant": s["role"] == "assistant", "record": s["train"]}[mode]

"""Rebuilding conversations from message rows.

Every live message gets its likeliest parent: candidate reply links are scored by
the stated parent, time, mentions and lexical overlap.  A stated parent that
exists outweighs everything; only messages whose stated parent doesn't exist get
candidates from their channel (message tree).  The chosen links form trees, which
pointer jumping resolves in a number of joins logarithmic in their depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_role, strip, visible
from corpusloom.operators.skew import cut_lineage, join_unique

#: Weight of a stated parent; above what the other parts of a score can reach together.
STATED = 10.0
WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{N}]+"
MENTION = r"@[\p{L}\p{N}_]{2,}|[«“„「『]([^»”“」』]{3,80})[»”“」』]"


def latest_messages(messages: DataFrame) -> DataFrame:
    """The row with the latest `ingested_at` of each message; deleted ones are left out.

    Ties are broken by the row's own values, so repeated rows give one.  Rows with a
    null id are left out.  A stated parent that is null or blank is null.
    """
    cols = ["parent_id", "message_tree_id", "role", "text", "rank", "created_date", "deleted"]
    last = F.max(F.struct("ingested_at", F.xxhash64(*cols).alias("h"), *cols))
    m = messages.where(F.col("message_id").isNotNull()).groupBy("message_id").agg(last.alias("m")).select("message_id", "m.*")
    parent = strip(F.coalesce("parent_id", F.lit("")))
    return m.where(~F.coalesce("deleted", F.lit(False))).select(
        "message_id", F.when(parent != "", parent).alias("parent_id"), "message_tree_id", normalize_role(F.col("role")).alias("role"), "text", "rank", "created_date"
    )


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def link_score(child: Column, parent: Column, hours: float) -> Column:
    """Likelihood score in 0..3 of a reply link from time, mentions and lexical overlap.

    A parent dated after its reply, as clocks and imports may have it, counts as twice as far away.
    """
    gap = (F.unix_micros(child["created_date"]) - F.unix_micros(parent["created_date"])) / 3.6e9
    time = F.exp(-F.when(gap >= 0, gap).otherwise(-2 * gap) / (hours / 4))
    a, b = words(child["text"]), words(parent["text"])
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))
    said = F.regexp_extract_all(F.coalesce(child["text"], F.lit("")), F.lit(MENTION), F.lit(0))
    named = F.exists(said, lambda x: F.contains(F.coalesce(parent["text"], F.lit("")), F.regexp_replace(x, "^[@«“„「『]|[»”“」』]$", "")))
    return time + overlap + F.when(named, 1.0).otherwise(0.0)


def _hour() -> Column:
    return F.floor(F.unix_micros("created_date") / 3.6e9).cast("bigint")


def reply_window(live: DataFrame, least: float = 6.0) -> tuple[float, float]:
    """Whole hours that cover how long after (`least` at least) and how long before its parent any stated reply is dated; one row reaches the driver."""
    above = live.select(F.col("message_id").alias("parent_id"), F.col("created_date").alias("before"))
    gap = F.unix_micros("created_date") - F.unix_micros("before")
    late, early = live.select("parent_id", "created_date").join(above, "parent_id").agg(F.max(gap), F.max(-gap)).first()
    hours = lambda x: float(-(-max(x or 0, 0) // 3_600_000_000))
    return max(least, hours(late)), hours(early)


def last_before(lost: DataFrame, live: DataFrame) -> DataFrame:
    """(message_id, parent): the latest message of another role in the same tree dated in an hour before that of each of `lost`.

    An exact as-of search by equal joins: the hours before an hour are a union of blocks
    of 1, 2, 4, … hours, one per bit set in it, and every block knows the last message of
    each role.  Neither a tree nor its messages meet in one task.  Ties go to the larger id.
    """
    first, end = live.agg(F.min(_hour()), F.max(_hour())).first()
    levels = F.sequence(F.lit(0), F.lit(max(1, ((end or 0) - (first or 0)).bit_length()) - 1))
    up = lambda: F.expr("shiftright(h, level)")
    at = (_hour() - F.lit(first or 0)).alias("h")
    last = F.max(F.struct("created_date", "message_id"))
    hours = live.where("created_date is not null").join(lost.select("message_tree_id").distinct(), "message_tree_id", "left_semi").groupBy("message_tree_id", "role", at).agg(last.alias("last"))
    blocks = hours.select("*", F.explode(levels).alias("level")).groupBy("message_tree_id", "role", "level", up().alias("block")).agg(F.max("last").alias("last"))
    seek = lost.where("created_date is not null").select("message_id", "message_tree_id", F.col("role").alias("own"), at).select("*", F.explode(levels).alias("level"))
    seek = seek.where(up() % 2 == 1).select("message_id", "message_tree_id", "own", "level", (up() - 1).alias("block"))
    met = seek.join(blocks, ["message_tree_id", "level", "block"]).where("role != own")
    return met.groupBy("message_id").agg(F.max("last").alias("last")).select("message_id", F.col("last.message_id").alias("parent"))


#: Keys up to this number, counted first, are broadcast to pick their rows; more are joined by shuffle.
FEW = 200_000


def picked(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of `df` whose `on` is among the distinct `keys`, which should be cheap to read twice."""
    return df.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, "left_semi")


def reply_links(live: DataFrame, hours: float | None = 6.0) -> DataFrame:
    """(message_id, parent, stated, score): the likeliest parent of each message that isn't a root.

    `parent` is null where neither the stated parent exists nor the channel offers a
    candidate: a message of the other speaker in the same message tree, dated up to
    `hours` before.  Candidates are met by (tree, hour), never as all pairs of a tree;
    ties go to the nearer, then to the smaller id.  With `hours` None the window covers
    the gaps of all stated links, those of parents dated after their reply too, and a
    message without a candidate inside it gets the latest earlier one of its tree.
    """
    limit, lead = reply_window(live) if hours is None else (hours, 0.0)
    # Only ids are joined; texts are read for the messages that lost their parents, and for their trees.
    child = live.where(F.col("parent_id").isNotNull()).select("message_id", "parent_id")
    ids = live.select(F.col("message_id").alias("parent_id"), F.lit(True).alias("known"))
    c = cut_lineage(child.join(ids, "parent_id", "left"))
    stated = c.where("known").select("message_id", F.col("parent_id").alias("parent"), F.lit(True).alias("stated"), F.lit(STATED).alias("score"))
    cols = ["message_id", "message_tree_id", "role", "text", "created_date"]
    hour = _hour()
    lost = cut_lineage(picked(live.select(*cols), c.where("known is null").select("message_id"), "message_id"))
    trees = cut_lineage(lost.select("message_tree_id").distinct())
    near = picked(live, trees, "message_tree_id")
    seek = lost.select("message_tree_id", F.explode(F.sequence(hour - F.lit(int(limit) + 1), hour + F.lit(int(lead) + (lead > 0)))).alias("hour"), F.struct(*cols).alias("child"))
    offer = near.select("message_tree_id", hour.alias("hour"), F.struct(*cols).alias("cand"))
    a, b = F.col("child"), F.col("cand")
    gap = F.unix_micros(a["created_date"]) - F.unix_micros(b["created_date"])
    met = seek.join(offer, ["message_tree_id", "hour"]).where((gap >= -int(lead * 3.6e9)) & (gap <= int(limit * 3.6e9)) & (a["role"] != b["role"]) & (a["message_id"] != b["message_id"]))
    scored = met.select(a["message_id"].alias("message_id"), link_score(a, b, limit).alias("score"), (-F.abs(gap)).alias("near"), b["message_id"].alias("parent"))
    best = scored.groupBy("message_id").agg(F.max_by(F.struct("parent", "score"), F.struct("score", "near", "parent")).alias("best"))
    if hours is None:
        best = cut_lineage(best)
        rest = lost.join(best, "message_id", "left_anti")
        back = last_before(rest, live).join(live.select(F.col("message_id").alias("parent"), F.struct(*cols).alias("cand")), "parent")
        back = rest.select("message_id", F.struct(*cols).alias("child")).join(back, "message_id")
        best = best.unionByName(back.select("message_id", F.struct("parent", link_score(a, b, limit).alias("score")).alias("best")))
    found = lost.select("message_id").join(best, "message_id", "left").select("message_id", F.col("best.parent").alias("parent"), F.lit(False).alias("stated"), F.col("best.score").alias("score"))
    return stated.unionByName(found)


def resolve_trees(nodes: DataFrame) -> DataFrame:
    """Follow the links of (id, ptr, end, good, seen) to the top by pointer jumping.

    `ptr` is the parent, null at a top; `end` says what a top is, 'root' or 'missing'
    (its parent doesn't exist), and is null elsewhere.  Adds `depth` and `on_cycle`; `good`
    and `seen` then hold for the whole path and `end` may be 'cycle'.  Each round
    doubles the distance, so a tree of depth d takes log2(d) joins.  Rows that are done
    are written once and only looked up.  When a round finishes none, what is open leads
    to cycles (an open row of a tree has one above it that this round would have
    finished); it jumps among itself until its images no longer shrink, which then are
    the cycles.  Loop counts are read to the driver, rows never are.
    """
    s = cut_lineage(nodes.select("id", "ptr", "end", "good", "seen", F.lit(1).cast("bigint").alias("depth")))
    done, open_ = [s.where("end is not null")], s.where("end is null")
    before, n = -1, open_.count()
    while n and n != before:
        every = open_
        for part in done:
            every = every.unionByName(part)
        top = every.select(F.col("id").alias("ptr"), F.struct(F.col("ptr").alias("p"), "end", "good", "seen", "depth").alias("t"))
        moved = cut_lineage(open_.join(top, "ptr").select(
            "id", F.col("t.p").alias("ptr"), F.col("t.end").alias("end"), (F.col("good") & F.col("t.good")).alias("good"),
            (F.col("seen") & F.col("t.seen")).alias("seen"), (F.col("depth") + F.col("t.depth")).alias("depth"),
        ))
        done.append(moved.where("end is not null"))
        open_ = moved.where("end is null")
        before, n = n, open_.count()
    cols = ["id", "end", "good", "seen", "depth"]
    out = done[0].select(*cols, F.lit(False).alias("on_cycle"))
    for part in done[1:]:
        out = out.unionByName(part.select(*cols, F.lit(False).alias("on_cycle")))
    if not n:
        return out
    before, images = -1, open_.select("ptr").distinct().count()
    while images != before:
        open_ = cut_lineage(open_.join(open_.select(F.col("id").alias("ptr"), F.col("ptr").alias("p")), "ptr").select("id", F.col("p").alias("ptr"), "good", "seen", "depth"))
        before, images = images, open_.select("ptr").distinct().count()
    ring = open_.select(F.col("ptr").alias("id"), F.lit(True).alias("on_cycle")).distinct()
    lost = open_.join(ring, "id", "left").select("id", F.lit("cycle").alias("end"), "good", "seen", "depth", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    return out.unionByName(lost)


def judged_messages(messages: DataFrame, hours: float | None = 6.0, inferred: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live messages, the links of their trees, and one row per message with its verdict.

    Verdict columns: message_id, leaf, on_cycle, reason (null: keep) and depth.  A path with a
    link that isn't the stated one never reaches a root by its own ids: it is broken,
    unless `inferred` lets the likeliest parents count as parents.
    """
    live = cut_lineage(latest_messages(messages))
    links = cut_lineage(reply_links(live, hours))
    own = live.select("message_id", "role", visible(F.col("text")).alias("seen"), F.col("parent_id").isNull().alias("root"))
    above = live.select(F.col("message_id").alias("parent"), F.col("role").alias("above"))
    e = own.join(links.select("message_id", "parent", "stated"), "message_id", "left").join(above, "parent", "left")
    speakers = F.col("role").isin("user", "assistant") & F.col("above").isin("user", "assistant")
    turn = F.when(F.col("root"), F.col("role") == "user").otherwise(F.coalesce(speakers & (F.col("role") != F.col("above")), F.lit(False)))
    end = F.when(F.col("root"), "root").when(F.col("above").isNull(), "missing")
    good = turn if inferred else turn & (F.col("root") | F.coalesce("stated", F.lit(False)))
    e = cut_lineage(e.select(F.col("message_id").alias("id"), F.col("parent").alias("ptr"), end.alias("end"), good.alias("good"), "seen", "role", "stated"))
    chosen = e.where("ptr is not null" if inferred else "ptr is not null and stated").select("id", "ptr")
    ends = resolve_trees(e)
    replied = chosen.select(F.col("ptr").alias("id")).distinct().withColumn("replied", F.lit(True))
    v = ends.join(replied, "id", "left").join(e.select("id", "role"), "id")
    reason = (
        F.when(F.col("on_cycle") | (F.col("end") != "root") | ~F.col("good"), "broken")
        .when(~F.col("seen"), "empty")
        .when(F.col("role") == "user", "no_reply")
    )
    verdict = v.select(F.col("id").alias("message_id"), F.col("replied").isNull().alias("leaf"), "on_cycle", reason.alias("reason"), "depth")
    return live, chosen, verdict


def dropped_conversations(messages: DataFrame, hours: float | None = 6.0) -> DataFrame:
    """(message_id, reason): conversations to drop, named by their last message, and messages on cycles."""
    _, _, v = judged_messages(messages, hours)
    return v.where((F.col("leaf") | F.col("on_cycle")) & F.col("reason").isNotNull()).select("message_id", "reason")


def conversations(messages: DataFrame, hours: float | None = 6.0, inferred: bool = False) -> DataFrame:
    """(message_id, turns, ranks): the kept conversations with ordered turns; `inferred` ones also run over the likeliest parents of messages that lost theirs.

    `turns` is an array of (message_id, role, content) from root to last message and
    `ranks` the ranks along it (null as 2147483647), by which siblings are ordered.
    Paths are walked by doubling: the ancestors 1, 2, 4, … steps up give all of them.
    """
    live, chosen, v = judged_messages(messages, hours, inferred)
    keep = v.where("leaf and reason is null").select("message_id", "depth")
    up = chosen.select(F.col("id").alias("at"), F.col("ptr").alias("to"))
    most = keep.agg(F.max("depth")).first()[0] or 0
    reach = keep.select("message_id", F.col("message_id").alias("at"), F.lit(0).cast("bigint").alias("steps"))
    jump, step = up, 1
    while step < most:
        # With all ancestors up to step-1 known, the jump by `step` gives those up to 2*step-1.
        reach = cut_lineage(reach.unionByName(reach.join(jump, "at").select("message_id", F.col("to").alias("at"), (F.col("steps") + step).alias("steps"))))
        nxt = jump.select(F.col("at").alias("to"), F.col("to").alias("to2"))
        jump = cut_lineage(jump.join(nxt, "to").select("at", F.col("to2").alias("to")))
        step *= 2
    said = live.select(F.col("message_id").alias("at"), "role", F.col("text").alias("content"), F.coalesce("rank", F.lit(2147483647)).alias("rank"))
    turn = F.struct((-F.col("steps")).alias("k"), F.col("at").alias("message_id"), "role", "content", "rank")
    many = cut_lineage(said.join(reach.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "at"))  # a root of many conversations is a hot key
    path = join_unique(reach, many, ["at"], "n", reach.count()).groupBy("message_id").agg(F.array_sort(F.collect_list(turn)).alias("p"))
    return path.select(
        "message_id",
        F.transform("p", lambda t: F.struct(t["message_id"].alias("message_id"), t["role"].alias("role"), t["content"].alias("content"))).alias("turns"),
        F.transform("p", lambda t: t["rank"]).alias("ranks"),
    )


def likely_parents(messages: DataFrame, hours: float | None = 6.0) -> DataFrame:
    """(message_id, parent, stated, score): the reply links chosen, with those found for messages that lost theirs (see `reply_links` for `hours`)."""
    return reply_links(cut_lineage(latest_messages(messages)), hours)

import datetime as dt

from corpusloom.llm import threads

DDL = "message_id string, parent_id string, message_tree_id string, role string, text string, rank int, deleted boolean, created_date timestamp, ingested_at timestamp, score string, steps int"


def messages(spark, rows):
    """(id, parent, role, text[, hour, deleted, ingested, rank])."""
    full = []
    for r in rows:
        i, p, role, text, hour, gone, seen, rank = (*r, *(0, None, 1, None)[len(r) - 4 :])
        full.append((i, p, "t", role, text, rank, gone, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), dt.datetime(2024, 2, seen), "clash", 1))
    return spark.createDataFrame(full, DDL)


ROWS = [
    ("r", None, "prompter", "hi"), ("a", "r", "gpt", "yo", 1), ("b", "a", "human", "so", 2), ("c", "b", "assistant", "ok", 3, None, 1, 0), ("c2", "b", "bot", " ​", 3, None, 1, 1),
    ("u", "a", "user", "and?", 2), ("same", "a", "assistant", "twice", 2), ("lost", "gone", "assistant", "x", 4), ("lone", " ", "assistant", "y"), ("x", "y", "user", "1"), ("y", "x", "assistant", "2"), ("tail", "x", "assistant", "3"), ("self", "self", "user", "s"),
    ("d", "r", "assistant", "old", 1, False, 1), ("d", "r", "assistant", "new", 1, True, 5), ("kid", "d", "user", "k", 2), ("mod", "r", "moderator", "m"), ("r", None, "prompter", "hi"), (None, "r", "assistant", "n"),
]


def test_reasons(spark):
    got = {(r["message_id"], r["reason"]) for r in threads.dropped_conversations(messages(spark, ROWS)).collect()}
    assert got == {("c2", "empty"), ("u", "no_reply"), ("same", "broken"), ("lost", "broken"), ("lone", "broken"), ("x", "broken"), ("y", "broken"), ("tail", "broken"), ("self", "broken"), ("kid", "broken"), ("mod", "broken")}


def test_conversations(spark):
    (r,) = threads.conversations(messages(spark, ROWS)).collect()
    assert r["message_id"] == "c" and [(t["role"], t["content"]) for t in r["turns"]] == [("user", "hi"), ("assistant", "yo"), ("user", "so"), ("assistant", "ok")] and r["ranks"][-1] == 0


def test_likely_parents(spark):
    rows = [("q1", None, "user", "how do I bake bread", 0), ("q2", None, "user", "which train goes north", 1), ("a1", "lost1", "assistant", "to bake bread you need flour", 2), ("far", "lost2", "assistant", "late", 300)]
    got = {r["message_id"]: (r["parent"], r["stated"]) for r in threads.likely_parents(messages(spark, rows)).collect()}
    assert got == {"a1": ("q1", False), "far": (None, False)}


def test_likely_parents_at_any_distance(spark):
    rows = [
        ("q1", None, "user", "how do I bake bread", 0), ("s1", "q1", "assistant", "in an oven", 25), ("q2", None, "user", "which train goes north", 12), ("a1", "lost1", "assistant", "to bake bread you need flour", 20),
        ("far", "lost2", "assistant", "late", 300), ("self", "lost3", "user", "first", 0), ("old", "lost4", "assistant", "before all", -5000),
    ]
    got = {r["message_id"]: (r["parent"], r["stated"]) for r in threads.likely_parents(messages(spark, rows), hours=None).collect()}
    assert got == {"s1": ("q1", True), "a1": ("q1", False), "far": ("q2", False), "self": ("old", False), "old": (None, False)}


def test_deep_chain_and_empty(spark):
    rows = [(f"m{i:03d}", f"m{i - 1:03d}" if i else None, "user" if i % 2 == 0 else "assistant", "t", i) for i in range(150)]
    (r,) = threads.conversations(messages(spark, rows)).collect()
    assert [t["message_id"] for t in r["turns"]] == [x[0] for x in rows]
    assert threads.dropped_conversations(messages(spark, [])).count() == 0

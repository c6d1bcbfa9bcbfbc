"""Every core query runs; those with SQL are held against DuckDB on the smallest tables."""

import ast
import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from corpusloom.plans import catalog


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_against_duckdb(spark, sf, name):
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = catalog.queries()[name](spark, sf)
    r = db.sql(catalog.oracle_sql()[name])
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    assert [r.columns[i] for i in order] == sorted(df.columns)
    want = Counter(tuple(plain(row[i]) for i in order) for row in r.fetchall())
    got = Counter(tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect())
    assert got == want


def test_every_query_has_a_twin():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"reasoning_examples"}


def numbers(text):
    return [int(x) for x in re.findall(r"\d+", text)]


def solve(kind, ask):
    """The answer of a reasoning task, worked out again from its text."""
    n = numbers(ask)
    if kind == "arithmetic":
        return str(eval(ask[3:-4]))
    if kind == "word_problem":
        item = re.search(r"原来有\d+个(.+?)，", ask).group(1)
        return f"{n[0] + n[1] - n[2]}个{item}"
    if kind == "compare":
        return str(max(n) if "最大" in ask else min(n) if "最小" in ask else sorted(n)[-2])
    if kind == "sort":
        return " ".join(map(str, sorted(n, reverse="从大到小" in ask)))
    if kind == "rule_transform":
        xs = numbers(ask[ask.index("[") :])
        return str([2 * x + 1 for x in xs]) if "2x+1" in ask else str([x * x - 1 for x in xs]) if "x*x" in ask else " ".join("奇" if x % 2 else "偶" for x in xs)
    if kind == "table_lookup":
        return str(ast.literal_eval(ask[4 : ask.index("}") + 1])[re.search("。(.+)的成绩", ask).group(1)])
    if kind == "relation_logic":
        item = re.search(r"有多少个(.+)？", ask).group(1)
        return f"{n[0] + n[1] - n[2]}个{item}"
    if kind == "set_logic":
        a, b = (set(ast.literal_eval(x)) for x in re.findall(r"\[.*?\]", ask))
        return " ".join(sorted(a & b if "交集" in ask else a | b if "并集" in ask else a - b)) or "空集"
    if kind == "path_reasoning":
        mid = re.search(r"到(.+?)是", ask[ask.index("。") :]).group(1)
        return f"经过{mid}" if n[1] + n[2] < n[0] else "直接走"
    seq = ask[ask.index("：") + 1 :].split("。")[0].split()
    if "反转" in ask:
        return " ".join(reversed(seq))
    return " ".join(dict.fromkeys(seq)) if "去重" in ask else str(seq.count(re.search("字母 (.) 出现", ask).group(1)))


def test_reasoning(spark, sf):
    rows = catalog.queries()["reasoning_examples"](spark, sf).collect()
    assert len({r["id"] for r in rows}) == 1000 and Counter(r["kind"] for r in rows) == {k: 100 for k in catalog.G.TASKS}
    assert [(r["input"], r["answer"]) for r in rows] == [(r["input"], solve(r["kind"], r["input"])) for r in rows]
    s = [tuple(r) for r in catalog.G.reversal_dataset(spark, 20, 1).select("question", "answer").collect()]
    assert all(a[::-1] == b for a, b in s) and len(set(s)) > 10


def test_merge_holds_every_source(spark, sf):
    got = {r["corpus"]: r["input"] for r in catalog.queries()["merge_corpora"](spark, sf).collect()}
    r = catalog.P.deliveries(spark.read.parquet(f"{sf}/training_records.parquet"))
    assert got["rest"] > 0 and got.pop("again") == got["worldtalk"] and sum(got.values()) == r.count()


def test_library_without_training_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "corpusloom.llm" in p.read_text()]

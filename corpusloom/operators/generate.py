"""Seeded row generators: reasoning tasks, character sequences, literal rows, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.dedup import number
from corpusloom.operators.dialog import segment
from corpusloom.operators.records import make_record

# Words of the tasks.
NAMES = ("小明", "小红", "小刚", "小丽", "阿宁", "小周", "小林", "小夏")
ITEMS = ("苹果", "梨", "石子", "书", "金币", "面包", "水晶", "零件")
COLORS = ("红", "蓝", "绿", "黄", "紫", "黑", "白")
ANIMALS = ("猫", "狗", "鸟", "马", "鱼", "兔")
PLACES = ("仓库", "教室", "城堡", "花园", "码头", "图书馆")
LETTERS = tuple("abcdefgxyz")
TASKS = ("arithmetic", "word_problem", "compare", "sort", "rule_transform", "table_lookup", "relation_logic", "set_logic", "path_reasoning", "string_reasoning")
# The wording of the tasks.
SUM = ("计算：{} + {} + {} = ?", "先算 {}+{}={}，再加 {}，得到 {}。")
DIFFERENCE = ("计算：{} - {} - {} = ?", "先算 {}-{}={}，再减 {}，得到 {}。")
PRODUCT = ("计算：{} * {} + {} = ?", "先乘法：{}*{}={}，再加 {}，得到 {}。")
BRACKETS = ("计算：({} + {}) * {} = ?", "括号优先：{}+{}={}，再乘 {}，得到 {}。")
STORY = ("{}原来有{}个{}，后来得到{}个，又用掉{}个。现在还有多少个{}？", "先把得到的加上：{}+{}={}；再减去用掉的 {}，所以剩下 {}。")
AMOUNT = ("{}个{}",)
COMPARE = ("数字列表：{}。请找出{}的数。", "比较这些数，最大的数是 {}。", "比较这些数，最小的数是 {}。", "先从大到小排序为 {}，第二大是 {}。")
EXTREMES = ("最大", "最小", "第二大")
SORT = ("把这些数字{}排序：{}", "按{}逐个排列，得到 {}。")
WAYS = ("从小到大", "从大到小")
DOUBLE = ("按规则 f(x)=2x+1 转换列表：{}", "对每个数先乘 2 再加 1，得到新列表。")
SQUARE = ("按规则 f(x)=x*x-1 转换列表：{}", "对每个数先平方再减 1，得到新列表。")
PARITY = ("判断列表中每个数的奇偶：{}", "能被 2 整除的是偶数，否则是奇数。", "偶", "奇")
TABLE = ("成绩表：{}。{}的成绩是多少？", "在成绩表中查找 {}，对应的值是 {}。")
RELATION = ("{}有{}个{}。{}比{}多{}个。{}比{}少{}个。{}有多少个{}？", "{}有 {}+{}={} 个；{}比{}少 {} 个，所以 {}-{}={}。")
SETS = ("A={}，B={}。求{}。", "交集", "交集表示同时在 A 和 B 中的元素，所以结果是 ", "并集", "并集表示属于 A 或 B 的所有元素，所以结果是 ", "只在A中", "只在 A 中表示属于 A 但不属于 B 的元素，所以结果是 ", "空集")
ROUTE = ("从{}到{}，直接距离{}。从{}到{}是{}，从{}到{}是{}。选择更短路线。", "经过{}的距离是 {}+{}={}，直接走是 {}，", "{} 更短。", "{} 不更长。", "经过", "直接走")
REVERSE = ("把序列反转：{}", "反转就是从最后一个元素开始依次写回到第一个元素。")
COUNT = ("序列：{}。字母 {} 出现了几次？", "逐个统计 {}，它在序列中出现 {} 次。")
UNIQUE = ("按首次出现顺序去重：{}", "从左到右保留第一次出现的元素，得到 {}。")
REPLY = ("思考：{}\n答案：{}",)


class _Draws:
    """Numbered draws of one row: each is a hash of seed, its number and the row, so rows don't depend on each other."""

    def __init__(self, seed: int):
        self.seed, self.n = seed, 0

    def raw(self) -> Column:
        self.n += 1
        return F.xxhash64(F.lit(self.seed), F.lit(self.n), "i")

    def number(self, low: int, high: int | Column) -> Column:
        """Evenly from low..high, both included."""
        top = F.lit(high) if isinstance(high, int) else high
        return (F.pmod(self.raw(), top - low + 1) + low).cast("int")

    def one(self, words: tuple[str, ...]) -> Column:
        return F.get(F.array(*map(F.lit, words)), self.number(0, len(words) - 1))

    def some(self, values: Column, n: int | Column) -> Column:
        """`n` values in a random order, none twice."""
        h = self.raw()
        mixed = F.transform(F.array_sort(F.transform(values, lambda v, k: F.struct(F.xxhash64(h, k).alias("h"), v.alias("v")))), lambda x: x["v"])
        return F.slice(mixed, F.lit(1), F.lit(n) if isinstance(n, int) else n)

    def many(self, low: int, high: int, n: Column) -> Column:
        """`n` independent numbers from low..high."""
        h = self.raw()
        return F.transform(F.sequence(F.lit(1), n), lambda k: (F.pmod(F.xxhash64(h, k), F.lit(high - low + 1)) + low).cast("int"))


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def _say(pattern: str, *args: Column) -> Column:
    """The pattern with each {} replaced by an argument."""
    parts = pattern.split("{}")
    out = [F.lit(parts[0])]
    for a, p in zip(args, parts[1:], strict=True):
        out += [a.cast("string"), F.lit(p)]
    return F.concat(*out)


def _numbers(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))


def _quoted(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _spaced(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


def _choose(k: Column, *options: tuple[Column, ...]) -> tuple[Column, ...]:
    """The k-th of several (prompt, reasoning, answer)."""
    pick = lambda cols: F.get(F.array(*cols), k)
    return tuple(pick(c) for c in zip(*options, strict=True))


def _arithmetic(d: _Draws):
    a, b, c = d.number(10, 999), d.number(10, 999), d.number(1, 99)
    e, f, g = d.number(200, 1500), d.number(1, 199), d.number(1, 99)
    h, i, j = d.number(2, 30), d.number(2, 20), d.number(1, 99)
    x, y, z = d.number(10, 99), d.number(2, 20), d.number(1, 50)
    return _choose(
        d.number(0, 3),
        (_say(SUM[0], a, b, c), _say(SUM[1], a, b, a + b, c, a + b + c), (a + b + c).cast("string")),
        (_say(DIFFERENCE[0], e, f, g), _say(DIFFERENCE[1], e, f, e - f, g, e - f - g), (e - f - g).cast("string")),
        (_say(PRODUCT[0], h, i, j), _say(PRODUCT[1], h, i, h * i, j, h * i + j), (h * i + j).cast("string")),
        (_say(BRACKETS[0], x, y, z), _say(BRACKETS[1], x, y, x + y, z, (x + y) * z), ((x + y) * z).cast("string")),
    )


def _word_problem(d: _Draws):
    name, item, start, gain = d.one(NAMES), d.one(ITEMS), d.number(3, 80), d.number(2, 50)
    lose = d.number(1, F.least(start + gain - 1, F.lit(40)))
    left = start + gain - lose
    return (
        _say(STORY[0], name, start, item, gain, lose, item),
        _say(STORY[1], start, gain, start + gain, lose, left), _say(AMOUNT[0], left, item),
    )


def _compare(d: _Draws):
    nums = d.many(1, 999, d.number(4, 7))
    down = F.sort_array(nums, asc=False)
    shown = lambda target: _say(COMPARE[0], _numbers(nums), F.lit(target))
    top, low, second = F.array_max(nums), F.array_min(nums), F.get(down, F.lit(1))
    return _choose(
        d.number(0, 2),
        (shown(EXTREMES[0]), _say(COMPARE[1], top), top.cast("string")),
        (shown(EXTREMES[1]), _say(COMPARE[2], low), low.cast("string")),
        (shown(EXTREMES[2]), _say(COMPARE[3], _numbers(down), second), second.cast("string")),
    )


def _sort(d: _Draws):
    nums = d.some(F.sequence(F.lit(1), F.lit(199)), d.number(5, 9))
    way = lambda name, out: (_say(SORT[0], F.lit(name), _numbers(nums)), _say(SORT[1], F.lit(name), _numbers(out)), _spaced(out))
    return _choose(d.number(0, 1), way(WAYS[0], F.array_sort(nums)), way(WAYS[1], F.sort_array(nums, asc=False)))


def _rule_transform(d: _Draws):
    nums = d.many(1, 30, d.number(4, 7))
    return _choose(
        d.number(0, 2),
        (_say(DOUBLE[0], _numbers(nums)), F.lit(DOUBLE[1]), _numbers(F.transform(nums, lambda n: 2 * n + 1))),
        (_say(SQUARE[0], _numbers(nums)), F.lit(SQUARE[1]), _numbers(F.transform(nums, lambda n: n * n - 1))),
        (_say(PARITY[0], _numbers(nums)), F.lit(PARITY[1]), F.array_join(F.transform(nums, lambda n: F.when(n % 2 == 0, PARITY[2]).otherwise(PARITY[3])), " ")),
    )


def _table_lookup(d: _Draws):
    people = d.some(_words(NAMES), 4)
    scores = [d.number(50, 100) for _ in range(4)]
    at = d.number(0, 3)
    who, score = F.get(people, at), F.get(F.array(*scores), at)
    table = F.concat(F.lit("{"), F.concat_ws(", ", *[_say("'{}': {}", F.get(people, F.lit(k)), s) for k, s in enumerate(scores)]), F.lit("}"))
    return _say(TABLE[0], table, who), _say(TABLE[1], who, score), score.cast("string")


def _relation_logic(d: _Draws):
    three = d.some(_words(NAMES), 3)
    a, b, c = (F.get(three, F.lit(k)) for k in range(3))
    x, y, z, item = d.number(2, 30), d.number(1, 20), d.number(1, 20), d.one(ITEMS)
    return (
        _say(RELATION[0], a, x, item, b, a, y, c, b, z, c, item),
        _say(RELATION[1], b, x, y, x + y, c, b, z, x + y, z, x + y - z), _say(AMOUNT[0], x + y - z, item),
    )


def _set_logic(d: _Draws):
    every = _words(COLORS + ANIMALS)
    a, b = (F.array_sort(d.some(every, d.number(3, 5))) for _ in range(2))

    def way(name: str, why: str, out: Column):
        r = F.array_sort(out)
        return _say(SETS[0], _quoted(a), _quoted(b), F.lit(name)), _say("{}{}。", F.lit(why), _quoted(r)), F.when(F.size(r) > 0, F.array_join(r, " ")).otherwise(SETS[7])

    return _choose(
        d.number(0, 2),
        way(SETS[1], SETS[2], F.array_intersect(a, b)),
        way(SETS[3], SETS[4], F.array_union(a, b)),
        way(SETS[5], SETS[6], F.array_except(a, b)),
    )


def _path_reasoning(d: _Draws):
    three = d.some(_words(PLACES), 3)
    start, mid, end = (F.get(three, F.lit(k)) for k in range(3))
    p, q, direct = d.number(2, 30), d.number(2, 30), d.number(2, 60)
    via = p + q
    ask = _say(ROUTE[0], start, end, direct, start, mid, p, mid, end, q)
    sum_ = _say(ROUTE[1], mid, p, q, via, direct)
    short = via < direct
    return ask, F.concat(sum_, F.when(short, _say(ROUTE[2], via)).otherwise(_say(ROUTE[3], direct))), F.when(short, F.concat(F.lit(ROUTE[4]), mid)).otherwise(ROUTE[5])


def _string_reasoning(d: _Draws):
    letters = d.some(_words(LETTERS), d.number(4, 7))
    pick = lambda a, k: F.get(a, F.pmod(k, F.size(a)).cast("int"))
    seq = F.transform(d.many(0, 1_000_000, d.number(7, 12)), lambda k: pick(letters, k))
    target = pick(letters, d.number(0, 1_000_000))
    n = F.size(F.filter(seq, lambda x: x == target))
    return _choose(
        d.number(0, 2),
        (_say(REVERSE[0], _spaced(letters)), F.lit(REVERSE[1]), _spaced(F.reverse(letters))),
        (_say(COUNT[0], _spaced(seq), target), _say(COUNT[1], target, n), n.cast("string")),
        (_say(UNIQUE[0], _spaced(seq)), _say(UNIQUE[1], _spaced(F.array_distinct(seq))), _spaced(F.array_distinct(seq))),
    )


def reasoning_examples(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """(i, task, input, reasoning, answer): ten kinds of tasks in turns, shuffled by the seed.

    A row depends on its number and the seed only.
    """
    kinds = (_arithmetic, _word_problem, _compare, _sort, _rule_transform, _table_lookup, _relation_logic, _set_logic, _path_reasoning, _string_reasoning)
    rows = spark.range(count).withColumnRenamed("id", "i")
    parts = []
    for k, make in enumerate(kinds):
        ask, why, answer = make(_Draws(seed * 1000 + k))
        parts.append(rows.where(F.col("i") % len(kinds) == k).select("i", F.lit(TASKS[k]).alias("task"), ask.alias("input"), why.alias("reasoning"), answer.alias("answer")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.orderBy(F.xxhash64(F.lit(seed), F.lit(99), "i"), "i")


def reasoning_records(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """The examples as canonical records, numbered from 1 in their order: the task asked, and reasoning and answer as the trained reply."""
    e = number(reasoning_examples(spark, count, seed).withColumn("h", F.xxhash64(F.lit(seed), F.lit(99), "i")), "reasoning-%06d", ["h", "i"], start=1)
    reply = _say(REPLY[0], F.col("reasoning"), F.col("answer"))
    s = F.array(segment(F.lit("user"), F.col("input")), segment(F.lit("assistant"), reply))
    return make_record(e, F.col("id"), F.lit("synthetic_reasoning"), s, F.to_json(F.struct("task", "reasoning", "answer")))


def char_ids(c: Column, alphabet: str, length: int, pad: int = 0) -> Column:
    """Characters → ids (1-based places in the alphabet, unknown ones left out), padded right and cut to `length`."""
    chars = F.filter(F.transform(F.split(c, ""), lambda x: F.position(x, F.lit(alphabet))), lambda i: i > 0)
    cut = F.slice(chars, F.lit(1), F.lit(length))
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def chars_of(ids: Column, alphabet: str) -> Column:
    """The inverse of `char_ids`, without padding."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i > 0), lambda i: F.substring(F.lit(alphabet), i, F.lit(1))), "")


def addition_dataset(spark: SparkSession, count: int, seed: int, length: int = 8) -> DataFrame:
    """(i, question, answer, x, y): sums of two numbers with character ids."""
    digits = "0123456789+="
    r = _Draws(seed)
    a, b = r.number(0, 999), r.number(0, 999)
    d = spark.range(count).withColumnRenamed("id", "i").select("i", _say("{}+{}=", a, b).alias("question"), (a + b).cast("string").alias("answer"))
    return d.withColumn("x", char_ids(F.col("question"), digits, length)).withColumn("y", char_ids(F.col("answer"), digits, length))


def reversal_dataset(spark: SparkSession, count: int, seed: int, alphabet: str = "abcdefghij", longest: int = 8) -> DataFrame:
    """(i, question, answer, x, y): strings of up to `longest` characters and their reversal, with character ids."""
    r = _Draws(seed)
    picks = r.many(0, len(alphabet) - 1, r.number(1, longest))
    d = spark.range(count).withColumnRenamed("id", "i").select("i", F.array_join(F.transform(picks, lambda k: F.substring(F.lit(alphabet), k + 1, F.lit(1))), "").alias("question"))
    d = d.withColumn("answer", F.reverse("question"))
    return d.withColumn("x", char_ids(F.col("question"), alphabet, longest)).withColumn("y", char_ids(F.col("answer"), alphabet, longest))


def literal_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(question, answer) from literals."""
    return spark.createDataFrame(rows, "question string, answer string")


def binarize(pixels: Column, threshold: float = 0.6) -> Column:
    """Pixels above the threshold become 1.0, others (equal ones too) 0.0."""
    return F.transform(pixels, lambda p: (p > threshold).cast("float"))


def pad_mask(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda i: i != pad)


def causal_mask(n: int) -> Column:
    """Rows of an n × n mask: place i sees the places up to i."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: j <= i))


def first_images(images: DataFrame, order: str, pixels: str = "pixels", n: int = 1000) -> DataFrame:
    """The first `n` images in order, with binary pixels."""
    return images.orderBy(order).limit(n).withColumn(pixels, binarize(F.col(pixels)))

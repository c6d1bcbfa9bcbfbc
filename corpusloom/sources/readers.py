"""Readers of the source formats.

Every reader is a DataFrame plan over Spark's file sources.  Archives can't be
split, so members are unpacked by one task per archive (`archive_members`) and
then read like other text.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import tarfile
import zipfile
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.operators import records as R
from corpusloom.operators.dedup import seeded_order
from corpusloom.operators.dialog import alternating, compact, segment
from corpusloom.schema import RECORD

# Encodings tried in this order; the last one replaces what it can't read.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
SUFFIXES = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json"}
SYNONYMS = {"txt": "text", "plain": "text", "ndjson": "jsonl"}


def resolve_format(path: str, fmt: str = "auto") -> str:
    """text, json or jsonl, by name or by suffix; other names are an error."""
    fmt = fmt.strip().lower()
    if fmt == "auto":
        fmt = SUFFIXES.get(PurePosixPath(path).suffix.lower(), "text")
    fmt = SYNONYMS.get(fmt, fmt)
    if fmt not in ("text", "json", "jsonl"):
        raise ValueError(f"unknown corpus format {fmt!r}")
    return fmt


def decode_bytes(b: bytes | None) -> str | None:
    if b is None:
        return None
    for e in ENCODINGS:
        try:
            return bytes(b).decode(e)
        except UnicodeDecodeError:
            continue
    return bytes(b).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decode_text(s: pd.Series) -> pd.Series:
    """Bytes → text by the first encoding that fits."""
    return s.map(decode_bytes)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file that has any bytes, whatever its encoding."""
    return spark.read.format("binaryFile").load(path).select("path", decode_text("content").alias("text"))


def lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(file, line_no, value): lines split at LF, numbered from 1 within their file; gzip by suffix.

    A file is read in blocks; a line's number is its place in its block plus the lines
    of the file's earlier blocks, a table of one row per block that is joined back, so
    no task holds more than a block.
    """
    t = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    n = t.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    begin = n.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("begin"))
    own = t.withColumn("i", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    out = own.join(begin, ["file", "block"]).select("file", (F.col("i") + F.col("begin")).cast("bigint").alias("line_no"), "value")
    return out if keep_blank else out.where(X.strip(F.col("value")) != "")


def json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, line_no, value) of JSON lines; malformed ones raise an error, or are left out if not `strict`."""
    rows = lines(spark, path)
    ok = X.json_value(F.col("value")).isNotNull()
    if not strict:
        return rows.where(ok)
    return rows.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed JSON in line "), F.col("line_no").cast("string")))))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """(value): a JSON list's items, or the one object of a document, as JSON text."""
    t = whole_texts(spark, path).select(F.parse_json("text").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return t.select(F.explode(items).alias("v")).select(F.to_json("v").alias("value"))


def read_corpus(spark: SparkSession, path: str, fmt: str = "auto", source: str | None = None, labels: bool = False, strict: bool = False) -> DataFrame:
    """(ord, kind, source, segments, rejected) of a corpus file in any supported format; `labels` reads role labels in plain text, `strict` fails on bad payloads."""
    fmt = resolve_format(path, fmt)
    src = F.lit(source or path)
    if fmt == "text":
        return whole_texts(spark, path).select(F.lit(1).alias("ord"), F.lit("text").alias("kind"), src.alias("source"), R.text_segments(F.col("text"), labels).alias("segments"), F.array().cast("array<struct<role:string,content:string,train:boolean>>").alias("rejected"))
    if fmt == "json":
        rows = json_document(spark, path).withColumn("ord", F.monotonically_increasing_id())
    else:
        rows = json_lines(spark, path).select(F.col("line_no").alias("ord"), "value")
    return R.parse_payloads(rows, "value", "ord", strict).withColumn("source", F.coalesce("source", src))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records from JSON lines; any other schema tag is an error."""
    r = spark.read.schema(RECORD).json(path)
    return r.withColumn("schema", F.when(F.col("schema") == "tl-corpus-v1", F.col("schema")).otherwise(F.raise_error(F.lit("not a canonical record"))))


def turn_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, segments) of (gzipped) lines that hold JSON arrays of turns; other lines are left out."""
    a = lines(spark, path).withColumn("turns", F.from_json("value", "array<string>")).where("turns is not null")
    return a.select("file", "line_no", alternating(F.col("turns")).alias("segments"))


def csv_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Quoted CSV with a header; fields may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=multi_line, escape='"')


def archive_members(spark: SparkSession, path: str, names: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """(archive, member, text) of zip, tar and tar.gz files, one task per archive; `names` picks members."""
    wanted = None if names is None else frozenset(names)

    def run(batches):
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for name, data in members(bytes(b)):
                    if wanted is None or name in wanted:
                        rows.append((p, name, data.decode(encoding) if encoding else decode_bytes(data)))
                yield pd.DataFrame(rows, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def members(data: bytes):
    """(name, bytes) of the files in an archive; plain gzip gives one of no name."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, z.read(i)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    except tarfile.ReadError:
        yield "", gzip.decompress(data)


def archive_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(archive, member, row_no, row) of the CSV members of archives: quoted fields may hold line breaks, the header names the keys of `row`."""
    wanted = None if names is None else frozenset(names)

    def run(batches):
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["content"], strict=True):
                for name, data in members(bytes(b)):
                    if wanted is None or name in wanted:
                        rows = csv.DictReader(io.StringIO(decode_bytes(data), newline=""))
                        out = [(p, name, i, {k: v for k, v in r.items() if isinstance(k, str) and isinstance(v, str)}) for i, r in enumerate(rows)]
                        yield pd.DataFrame(out, columns=["archive", "member", "row_no", "row"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, row_no bigint, row map<string,string>")


def utterance_dialogues(rows: DataFrame) -> DataFrame:
    """(member, conv_id, segments, context, prompt) of utterance rows as `archive_csv` gives them, ordered by `utterance_idx` as a number."""
    at = lambda k: F.coalesce(F.try_element_at("row", F.lit(k)), F.lit(""))
    u = rows.select("member", at("conv_id").alias("conv_id"), F.coalesce(at("utterance_idx").try_cast("int"), F.lit(0)).alias("idx"), at("speaker_idx").alias("who"), at("utterance").alias("said"), F.struct("row_no", at("context").alias("context"), at("prompt").alias("prompt")).alias("m"))
    meta = u.groupBy("member", "conv_id").agg(F.min(F.struct("idx", "m")).alias("f"))
    talk = R.speaker_roles(u, ["member", "conv_id"], "idx", "who", "said")
    talk = talk.withColumn("segments", X.nfc_segments(F.col("segments"))).withColumn("segments", compact(F.col("segments"), clean=lambda c: X.clean_each_line(c, False)))
    return talk.join(meta, ["member", "conv_id"]).select("member", "conv_id", "segments", "f.m.context", "f.m.prompt")


def movie_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """(conv, movie, segments) of a zip with `movie_lines.txt` and `movie_conversations.txt`, latin-1, split at ' +++$+++ '.

    Rows with too few fields are left out; of repeated line ids the last counts.
    """
    m = member_lines(archive_members(spark, path, encoding="latin-1"))
    own = lambda name: m.where(F.col("member").endswith(f"/{name}") | (F.col("member") == name))
    said = own("movie_lines.txt").select("line_no", delimited(F.col("value")).alias("f")).where(F.size("f") == 5)
    said = said.select("line_no", F.get("f", F.lit(0)).alias("line"), X.clean_each_line(F.get("f", F.lit(4))).alias("text"))
    talk = own("movie_conversations.txt").select(F.col("line_no").alias("conv"), delimited(F.col("value"), fields=4).alias("f")).where(F.size("f") == 4)
    talk = talk.select("conv", F.get("f", F.lit(2)).alias("movie"), X.literal_list(F.get("f", F.lit(3))).alias("ids"))
    return talk.select("conv", "movie").join(R.line_id_join(talk, "conv", "ids", said, "line", "text", "line_no"), "conv")


def skill_dialogues(table: DataFrame) -> DataFrame:
    """(…, segments): `previous_utterance` by turns, then `free_messages` and `guided_messages` in pairs, merged; null arrays are empty."""
    none = F.array().cast("array<string>")
    before = alternating(F.coalesce("previous_utterance", none))
    s = F.concat(before, R.paired_utterances(F.coalesce("free_messages", none), F.coalesce("guided_messages", none)))
    return table.withColumn("segments", X.nfc_segments(s)).withColumn("segments", compact(F.col("segments"), clean=lambda c: X.clean_each_line(c, False)))


def dataset(spark: SparkSession, root: str, name: str, subset: str | None = None, split: str = "train", seed: int | None = None) -> DataFrame:
    """A split of a dataset laid out as root/name[/subset]/split.parquet, .jsonl, .json or .csv (a file or folder); with `seed` its rows in the seed's order.

    The connector of dataset hubs: whatever fetched the files, the split is one scan.
    """
    folder = "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate((root, name, subset)) if x)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for suffix, read in (("parquet", spark.read.parquet), ("jsonl", spark.read.json), ("json", lambda p: spark.read.json(p, multiLine=True)), ("csv", lambda p: csv_rows(spark, p))):
        path = fs.Path(f"{folder}/{split}.{suffix}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            df = read(path.toString())
            return df if seed is None else seeded_order(df, seed, *[c for c, t in df.dtypes if "map<" not in t and t != "variant"])
    raise FileNotFoundError(f"no split {split!r} below {folder}")


def member_lines(df: DataFrame) -> DataFrame:
    """(archive, member, line_no, value) of the non-blank lines of archive members."""
    return df.select("archive", "member", F.posexplode(F.split(X.unify_newlines(F.col("text")), "\n")).alias("p", "value")).where(X.strip(F.col("value")) != "").select("archive", "member", (F.col("p") + 1).alias("line_no"), "value")


def delimited(c: Column, sep: str = " +++$+++ ", fields: int = 5) -> Column:
    """Fields of a line split at a literal separator, the last one holding the rest."""
    quoted = "".join("\\" + x if not x.isalnum() and x != " " else x for x in sep)
    return F.transform(F.split(c, quoted, fields), lambda x: F.trim(x))


def grounded_dialogues(values: Column) -> Column:
    """Turns of a grounded dialogue: `conversation`, or `history` and `response`."""
    conv = F.from_json(F.get_json_object(values, "$.conversation"), "array<string>")
    hist = F.from_json(F.get_json_object(values, "$.history"), "array<string>")
    resp = F.get_json_object(values, "$.response")
    return alternating(F.coalesce(conv, F.concat(F.coalesce(hist, F.array().cast("array<string>")), F.array(resp))))


def topic_dialogues(values: Column) -> Column:
    """A dialogue with a `name` and `messages[].message`; a name without ASCII letters becomes a system turn."""
    name = F.get_json_object(values, "$.name")
    turns = F.transform(F.from_json(F.get_json_object(values, "$.messages"), "array<struct<message: string>>"), lambda m: m["message"])
    head = F.when(name.isNotNull() & ~name.rlike("[A-Za-z]"), F.array(segment(F.lit("system"), name))).otherwise(F.array().cast("array<struct<role:string,content:string,train:boolean>>"))
    return F.concat(head, alternating(turns))


def task_dialogues(df: DataFrame, value: str) -> DataFrame:
    """(dialog_id, segments) of an object whose keys are dialogue ids, with roles usr and sys."""
    m = df.select(F.explode(F.from_json(value, "map<string, struct<messages: array<struct<role: string, content: string>>>>")).alias("dialog_id", "d"))
    s = F.transform("d.messages", lambda x: segment(X.normalize_role(x["role"], True), F.coalesce(x["content"], F.lit(""))))
    return m.select("dialog_id", F.filter(s, lambda x: X.strip(x["content"]) != "").alias("segments"))


def paired_dialogues(values: Column) -> Column:
    """`dialogue` as a list of user and system utterances → segments, blank sides left out."""
    p = F.from_json(F.get_json_object(values, "$.dialogue"), "array<struct<user_utterance: string, system_utterance: string>>")
    both = F.transform(p, lambda x: F.array(segment(F.lit("user"), F.coalesce(x["user_utterance"], F.lit(""))), segment(F.lit("assistant"), F.coalesce(x["system_utterance"], F.lit("")))))
    return F.filter(F.flatten(both), lambda s: X.strip(s["content"]) != "")


def union_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet splits as one table with `split_ord`; missing columns are null."""
    parts = [spark.read.parquet(p).withColumn("split_ord", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# Elements without content, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style template".split())
#: Selectors of an article's body, the first with any text wins: a tag, a class, or a part of the class attribute.
NEWS_BODIES = ("article", ".article-content", ".news-content", ".content", '[class*="article"]', '[class*="news"]')


class _Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items = tag, attrs, []

    def below(self):
        """All elements inside, in the order of their start tags."""
        for x in self.items:
            if isinstance(x, _Node):
                yield x
                yield from x.below()

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else "" if x.tag in UNSEEN else x.text() for x in self.items)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def matches(self, selector: str) -> bool:
        if selector.startswith("."):
            return selector[1:] in self.classes()
        if selector.startswith("[class*="):
            return selector[9:-2] in self.attrs.get("class", "")
        return self.tag == selector


class _Tree(HTMLParser):
    """A page's elements; an end tag closes what is open inside its element, and none if the element isn't open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].items.append(data)


def page(html: str | None) -> _Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())])


def encyclopedia_article(html: str | None, paragraphs: int = 5, least: int = 50) -> tuple[str | None, str]:
    """Heading (null without one) and, of the first `paragraphs` paragraphs of the body, those longer than `least`."""
    every = list(page(html).below())
    head = next((n for n in every if n.tag == "h1" and "firstHeading" in n.classes()), None)
    body = next((n for n in every if n.tag == "div" and "mw-parser-output" in n.classes()), None)
    first = [n.text().strip() for n in body.below() if n.tag == "p"][:paragraphs] if body else []
    return head.text() if head else None, "\n\n".join(t for t in first if len(t) > least)


def news_article(html: str | None, selectors: tuple[str, ...] = NEWS_BODIES, least: int = 30, total: int = 100) -> tuple[str | None, str]:
    """Title (the first h1, else the page's, else null) and body; '' for a body up to `total` characters.

    The body is the paragraphs and divisions, longer than `least`, of the first element
    that has any, by the order of the selectors; nested ones repeat their text.
    """
    every = list(page(html).below())
    head = next((n for n in every if n.tag == "h1"), None) or next((n for n in every if n.tag == "title"), None)
    text = ""
    for s in selectors:
        for n in every:
            if not text and n.matches(s):
                text = "".join(f"{t}\n\n" for t in (x.text().strip() for x in n.below() if x.tag in ("p", "div")) if len(t) > least)
        if text:
            break
    return head.text().strip() if head else None, text.strip() if len(text) > total else ""


def _page_udf(parse, *args):
    @F.pandas_udf(PAGE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(h, *args) for h in s], columns=["title", "content"])

    return run


def article_udf(paragraphs: int = 5, least: int = 50):
    """Encyclopedia page → (title, content), see `encyclopedia_article`."""
    return _page_udf(encyclopedia_article, paragraphs, least)


def news_udf(selectors: tuple[str, ...] = NEWS_BODIES, least: int = 30, total: int = 100):
    """News page → (title, content), see `news_article`."""
    return _page_udf(news_article, selectors, least, total)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, token) of vocab.txt lines, or of a JSON file's model.vocab by id."""
    if path.endswith(".json"):
        v = whole_texts(spark, path).select(F.explode(F.from_json(F.get_json_object("text", "$.model.vocab"), "map<string,int>")).alias("token", "ord"))
        return v.select("ord", "token")
    return lines(spark, path, keep_blank=True).select((F.col("line_no") - 1).alias("ord"), F.col("value").alias("token"))


def token_list(path: str) -> list[str]:
    """Tokens of a saved tokenizer (a small file, read by the driver)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["id_to_token"]

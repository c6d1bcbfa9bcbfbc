"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

The ledger is stored in hash buckets, one row per canonical key, beside the ids it
has counted.  Each new batch is stripped of ids counted before, aggregated by key
(partially before the shuffle, so that a key with a third of all rows moves as a few
rows) and joined by a full outer join to the buckets it meets, which alone are read
and written anew; counts are added and the earliest representative is kept.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import fold_case, normalize_role
from corpusloom.operators.skew import checkpoint_folder, cut_lineage, hash_bucket, join_unique

LEDGER_DDL = "tbl string, key binary, copies bigint, first struct<at: timestamp, id: string>, least_id string, bucket int"
MEMBERS_DDL = "tbl string, id string, key binary, at timestamp, bucket int"
RAW_DDL = "source string, segments array<struct<role: string, content: string>>"


@F.pandas_udf(T.BooleanType())
def is_json_object(s: pd.Series) -> pd.Series:
    """Whether the whole line is one JSON object.  Null isn't.

    Spark's own parsers take a line for valid that has more behind its first value, and
    one with a repeated key for invalid.
    """

    def one(x):
        try:
            return isinstance(json.loads(x), dict)
        except (TypeError, ValueError, RecursionError):
            return False

    return s.map(one).astype(bool)


def canonical_text(c: Column) -> Column:
    """The text without white space, punctuation, control and format characters, case folded; null as ''."""
    return F.regexp_replace(fold_case(F.coalesce(c, F.lit(""))), r"[\p{P}\p{Z}\p{Cc}\p{Cf}]+", "")


def canonical_key(source: Column, segments: Column) -> Column:
    """128-bit key of a record: source and the sequence of (role after aliases, content), free of formatting.

    Null source, segments, roles and contents count as empty.  Ids, train flags,
    task, meta and rejected segments have no part in it.
    """
    parts = F.transform(
        F.coalesce(segments, F.array()),
        lambda s: F.concat(normalize_role(s["role"]), F.lit("\x01"), canonical_text(s["content"])),
    )
    return F.unhex(F.md5(F.concat_ws("\x02", canonical_text(source), F.array_join(parts, "\x03"))))


def parse_raw(raw: DataFrame, line: str = "line") -> DataFrame:
    """Rows whose line is one whole JSON object, with its `source` and `segments`; other rows are left out.

    Keys the canonical record lacks are ignored; a missing or null key gives null.
    """
    j = F.from_json(F.col(line), RAW_DDL)
    return raw.where(is_json_object(F.col(line))).select("*", j.alias("_r")).select(*raw.columns, "_r.source", "_r.segments")


def first_deliveries(rows: DataFrame) -> DataFrame:
    """(tbl, id, key, at) with one row per (tbl, id): of several deliveries of an id the first, ties by key."""
    one = F.min(F.struct("at", "key"))
    return rows.groupBy("tbl", "id").agg(one.alias("d")).select("tbl", "id", "d.key", "d.at")


def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Ledger rows after a batch: full outer join by bucket and key, counts added, the smallest (at, id) kept, null times first."""
    if old is None:
        return new
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.key") == F.col("b.key")), "full_outer")
    zero = F.lit(0)
    return both.select(
        F.coalesce("a.tbl", "b.tbl").alias("tbl"),
        F.coalesce("a.key", "b.key").alias("key"),
        (F.coalesce("a.copies", zero) + F.coalesce("b.copies", zero)).alias("copies"),
        F.least("a.first", "b.first").alias("first"),
        F.least("a.least_id", "b.least_id").alias("least_id"),
        F.coalesce("a.bucket", "b.bucket").alias("bucket"),
    )


class Ledger:
    """A ledger in a folder that all executors share.

    Below `path`, `ledger/gen=g/bucket=b` holds the rows of a bucket as the g-th batch
    left it and `members/gen=g/bucket=b` the ids that batch counted.  A generation is
    read only once `done/gen=g`, written last, lists its buckets, so a batch that fails
    leaves the ledger as it was and can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 1024):
        self.spark, self.path, self.n = spark, path.rstrip("/"), n_buckets

    def _generations(self) -> list[tuple[int, str, int]]:
        """(gen, table, bucket) of all finished batches: at most two rows a bucket and batch, read by the driver."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return [tuple(r) for r in self.spark.read.schema("tbl string, bucket int, gen int").parquet(f"{self.path}/done").select("gen", "tbl", "bucket").collect()]

    def _read(self, name: str, ddl: str, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], ddl)
        base = f"{self.path}/{name}"
        df = self.spark.read.schema(ddl + ", gen int").option("basePath", base).parquet(*[f"{base}/gen={g}/bucket={b}" for g, b in sorted(parts)])
        return df.drop("gen")

    def table(self, buckets: set[int] | None = None) -> DataFrame:
        """The ledger's rows, of some buckets or of all."""
        last: dict[int, int] = {}
        for g, t, b in self._generations():
            if t == "ledger" and (buckets is None or b in buckets):
                last[b] = max(g, last.get(b, 0))
        return self._read("ledger", LEDGER_DDL, [(g, b) for b, g in last.items()])

    def members(self, buckets: set[int] | None = None) -> DataFrame:
        """(tbl, id, key, at, bucket) of the ids counted."""
        return self._read("members", MEMBERS_DDL, [(g, b) for g, t, b in self._generations() if t == "members" and (buckets is None or b in buckets)])

    def _write(self, df: DataFrame, name: str, gen: int) -> set[int]:
        """Write rows into the generation's buckets; a bucket's rows come from several tasks where they are many."""
        df.repartition(F.col("bucket"), F.pmod(F.xxhash64("key"), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/gen={gen}")
        return {r[0] for r in df.select("bucket").distinct().collect()}

    def update(self, batch: DataFrame) -> None:
        """Add a batch (tbl, id, key, at).  Ids counted before, in this batch or an earlier one, don't count again; an empty batch changes nothing."""
        gen = max((g for g, _, _ in self._generations()), default=0) + 1
        rows = first_deliveries(batch).select("tbl", "id", "key", "at", hash_bucket(F.struct("tbl", "id"), self.n).alias("bucket"))
        rows = cut_lineage(rows)
        met = {r[0] for r in rows.select("bucket").distinct().collect()}  # at most n_buckets
        seen = self.members(met).select("bucket", "tbl", "id")
        fresh = cut_lineage(rows.join(seen, ["bucket", "tbl", "id"], "left_anti").select("tbl", "id", "key", "at", "bucket")) if gen > 1 else rows
        new = fresh.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("at", "id")).alias("first"), F.min("id").alias("least_id"))
        new = cut_lineage(new.select("*", hash_bucket(F.col("key"), self.n).alias("bucket")))
        met = {r[0] for r in new.select("bucket").distinct().collect()}
        if not met:
            return
        done = [("members", b) for b in self._write(fresh, "members", gen)]
        done += [("ledger", b) for b in self._write(merge(self.table(met) if gen > 1 else None, new), "ledger", gen)]
        self.spark.createDataFrame([(t, b, gen) for t, b in done], "tbl string, bucket int, gen int").coalesce(1).write.mode("append").partitionBy("gen").parquet(f"{self.path}/done")


def keyed_records(records: DataFrame) -> DataFrame:
    """training_records → (tbl, id, key, at)."""
    return records.select(F.lit("training_records").alias("tbl"), "id", canonical_key(F.col("source"), F.col("segments")).alias("key"), F.col("ingested_at").alias("at"))


def keyed_raw(raw: DataFrame) -> DataFrame:
    """raw_records → (tbl, id, key, at); lines that aren't JSON objects are left out."""
    p = parse_raw(raw.select("raw_id", "line", "loaded_at"))
    return p.select(F.lit("raw_records").alias("tbl"), F.col("raw_id").alias("id"), canonical_key(F.col("source"), F.col("segments")).alias("key"), F.col("loaded_at").alias("at"))


def build_ledger(rows: DataFrame, n_buckets: int = 64) -> Ledger:
    """A new ledger over (tbl, id, key, at) in two batches, in the shared checkpoint folder.

    The batches are the rows before and after the middle of the delivery times, as
    if the second had come later.  Keys hold the table's name, so records of
    different tables never meet.
    """
    keyed = cut_lineage(rows.where(F.col("id").isNotNull()).select("tbl", "id", F.unhex(F.md5(F.concat(F.encode("tbl", "utf-8"), "key"))).alias("key"), "at"))
    ledger = Ledger(rows.sparkSession, f"{checkpoint_folder(rows.sparkSession)}/ledger-{uuid.uuid4().hex}", n_buckets)
    lo, hi = keyed.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    late = F.coalesce(F.unix_micros("at") > F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(False))
    ledger.update(keyed.where(~late))
    ledger.update(keyed.where(late))
    return ledger


def hidden_duplicates(rows: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(tbl, id_a, id_b): each record that repeats another, with the smallest id of its group.

    Rows with null ids are no cases.  Further deliveries of an id aren't either.  A group
    may hold a third of all records: `join_unique` broadcasts the hot ones.
    """
    book = ledger or build_ledger(rows)
    groups = cut_lineage(book.table().where(F.col("copies") > 1).select("key", F.col("least_id").alias("id_a"), "copies"))
    members = book.members().select("tbl", "id", "key")
    total = book.table().agg(F.sum("copies")).first()[0] or 0
    hit = join_unique(members, groups, ["key"], "copies", total).where("id_a is not null")
    return hit.where(F.col("id") != F.col("id_a")).select("tbl", "id_a", F.col("id").alias("id_b"))


def collapse(rows: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(tbl, id, copies): one row per group of the same records, named by its earliest delivery (ties by id)."""
    return (ledger or build_ledger(rows)).table().select("tbl", F.col("first.id").alias("id"), "copies")

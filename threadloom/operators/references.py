"""References to records that were never stored, were deleted, or were stored only later.

The distinct non-null foreign keys, each with the earliest and latest row that names it, are anti-joined to the parent
keys; the orphan keys that remain are joined back to the rows for their state and for counts by table and period. Keys
are aggregated before each shuffle, so a key that a third of all rows name costs one row per task; the join back is
salted on both sides for the same reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.tables import one_form

SALTS = 8


def links(emails: DataFrame, threads: DataFrame) -> DataFrame:
    """(rec_table, rec_field, rec_key, target, key, at): one row for each non-blank reference."""

    def of(t: DataFrame, name: str, field: str, target: str) -> DataFrame:
        return t.select(
            F.lit(name).alias("rec_table"), F.lit(field).alias("rec_field"), F.col("id").cast("string").alias("rec_key"), F.lit(target).alias("target"), one_form(field).alias("key"), F.col("created_at").cast("double").alias("at")
        )

    every = [of(emails, "emails", "thread_id", "thread"), of(emails, "emails", "in_reply_to", "mail"), of(threads, "threads", "root_message_id", "mail"), of(threads, "threads", "id", "filed")]
    return reduce(DataFrame.unionByName, every).where(F.col("key").isNotNull())


def parents(emails: DataFrame, threads: DataFrame) -> DataFrame:
    """(target, key, first_at): the keys that references may name, with the time their first row was stored."""
    of = lambda t, field, target: t.select(F.lit(target).alias("target"), one_form(field).alias("key"), F.col("created_at").cast("double").alias("at"))
    rows = of(emails, "message_id", "mail").unionByName(of(threads, "id", "thread")).unionByName(of(emails, "thread_id", "filed"))
    return rows.where(F.col("key").isNotNull()).groupBy("target", "key").agg(F.min(F.coalesce("at", F.lit(float("-inf")))).alias("first_at"))


def orphans(emails: DataFrame, threads: DataFrame, removals: DataFrame, salts: int = SALTS) -> DataFrame:
    """(rec_table, rec_field, rec_key, state, at): each reference that found no row when its own row was stored.

    state: `late` if rows with the key exist but all were stored after the referring row, `deleted` if none exists and
    removals holds the key with the target's kind (not for threads.id), else `missing`. Null and blank keys name
    nothing. A referring or a target row without created_at counts as present at all times. Repeated rows each count.
    Empty tables give no rows, or all references as missing where only the parents are empty.
    """
    links_, parents_ = links(emails, threads), parents(emails, threads)
    keys = links_.groupBy("target", "key").agg(F.min(F.coalesce("at", F.lit(float("inf")))).alias("first_use"))
    p = parents_.alias("p")
    # anti join: a parent that was there at the first use serves every use
    open_keys = keys.alias("k").join(p, (F.col("k.target") == F.col("p.target")) & (F.col("k.key") == F.col("p.key")) & (F.col("p.first_at") <= F.col("k.first_use")), "left_anti")
    gone = removals.select(F.when(F.col("record_kind") == "mail", "mail").when(F.col("record_kind") == "thread", "thread").alias("target"), one_form("record_key").alias("key")).where("target is not null and key is not null").distinct().withColumn("gone", F.lit(True))
    open_keys = open_keys.select("target", "key").join(parents_, ["target", "key"], "left").join(gone, ["target", "key"], "left")
    state = F.when(F.col("first_at").isNotNull(), "late").when(F.col("gone"), "deleted").otherwise("missing")
    spread = open_keys.select("target", "key", "first_at", state.alias("state"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = links_.withColumn("salt", F.pmod(F.xxhash64("rec_key", "rec_field"), F.lit(salts)).cast("int"))
    back = salted.join(spread, ["target", "key", "salt"])
    return back.where((F.col("state") != "late") | (F.col("first_at") > F.col("at"))).select("rec_table", "rec_field", "rec_key", "state", "at")


def orphan_counts(found: DataFrame) -> DataFrame:
    """(rec_table, rec_field, state, period, n): orphan references by the month in which the referring row was stored."""
    period = F.date_format(F.timestamp_seconds("at"), "yyyy-MM")
    return found.groupBy("rec_table", "rec_field", "state", F.coalesce(period, F.lit("none")).alias("period")).agg(F.count("*").alias("n"))

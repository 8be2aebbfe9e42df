"""Operators of the store: look-ups, pages, statistics, topics, queue, cache and the repair of thread links."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M
from threadloom.operators import timestamps

MAIL_SORTS = ("date", "from_name", "subject", "relevance_score", "created_at")


def lookup(df: DataFrame, **equal: object) -> DataFrame:
    """Rows with the given values; null matches nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), equal.items(), df)


def unprocessed(df: DataFrame, limit: int) -> DataFrame:
    return df.where("processed = 0").orderBy("created_at", "id").limit(limit)


def visible(threads: DataFrame, include_hidden: bool = False) -> DataFrame:
    return threads if include_hidden else threads.where("hidden = 0")


def untranslated(threads: DataFrame) -> DataFrame:
    return visible(threads).where("translated_html_path is null or translated_html_path = ''")


def like(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in one of the columns, in any case. `%` and `_` are wild, as in the web search."""
    return df.where(reduce(or_, [F.col(c).ilike(f"%{text}%") for c in columns]))


def page(df: DataFrame, page: int, per_page: int, sort: str, order: str = "desc", sorts: tuple[str, ...] = MAIL_SORTS, default: str = "date") -> DataFrame:
    """One page with total and pages. An unknown sort column means the default, an unknown order descending."""
    by = sort if sort in sorts else default
    key = F.asc_nulls_first(by) if order.lower() == "asc" else F.desc_nulls_last(by)
    total = df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint").alias("pages"))
    return df.orderBy(key, "id").offset((max(1, page) - 1) * per_page).limit(per_page).join(F.broadcast(total))


def stats(emails: DataFrame, threads: DataFrame, *others: DataFrame) -> DataFrame:
    """All counts of the store in one row, one scan for each table."""
    mails = emails.agg(F.count("*").alias("emails"), F.count_if(F.col("processed") == 1).alias("emails_processed"))
    talks = threads.agg(F.count("*").alias("threads"), F.count_if(F.col("hidden") == 0).alias("threads_visible"), F.count_if(F.col("processed") == 1).alias("threads_processed"))
    rest = [df.agg(F.count("*").alias(name)) for df, name in zip(others, ("topics", "jobs", "queue"), strict=True)]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rest, mails.join(F.broadcast(talks)))


def dated(df: DataFrame, column: str) -> DataFrame:
    """df with sent_at, the instant that a text date denotes."""
    return timestamps.normalise(df, column, F.lit(column)).withColumn("sent_at", F.timestamp_micros("utc_us"))


def top(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def score_buckets(df: DataFrame) -> DataFrame:
    s = F.col("relevance_score")
    return df.agg(F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.4) & (s < 0.8)).alias("medium"), F.count_if(s < 0.4).alias("low"))


def topic_counts(topics: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("n"))
    return topics.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("thread_count"))


def topic_threads(threads: DataFrame, links: DataFrame, topic: int, include_hidden: bool = False) -> DataFrame:
    chosen = links.where(F.col("topic_id") == topic).select(F.col("thread_id").alias("id"), "confidence")
    return visible(threads, include_hidden).join(chosen, "id")


def first_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as insert-or-ignore leaves it. Aggregated before the shuffle, so a hot key is cheap."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def last_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as replace leaves it."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


STATES = ["pending", "downloading", "completed", "failed"]


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.count("*").alias("total"))


def queue_next(queue: DataFrame, status: str, limit: int) -> DataFrame:
    """The next items of each job: highest priority first, then oldest."""
    w = W.partitionBy("job_id").orderBy(F.desc_nulls_last("priority"), F.asc_nulls_first("created_at"), "id")
    return queue.where(F.col("status") == status).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def reset_queue(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status").isin("downloading", "failed"), "pending").otherwise(F.col("status")))


def progress_cursor(jobs: DataFrame) -> DataFrame:
    """(id, keywords, last_date) from the JSON progress of each job: how many keywords have a cursor, and the latest."""
    cursors = F.from_json("progress", "map<string,struct<last_date:string,updated_at:string>>")
    dates = F.transform(F.map_values(cursors), lambda v: v["last_date"])
    return jobs.select("id", F.coalesce(F.size(cursors), F.lit(0)).alias("cursors"), F.array_max(dates).alias("last_date"))


def threads_without_mail(threads: DataFrame, emails: DataFrame) -> DataFrame:
    filed = emails.where("thread_id <> ''").select(F.col("thread_id").alias("id")).distinct()
    return visible(threads).join(filed, "id", "left_anti")


def mail_without_thread(threads: DataFrame, emails: DataFrame) -> DataFrame:
    return emails.where("thread_id <> ''").join(threads.select(F.col("id").alias("thread_id")), "thread_id", "left_anti")


def repair_create(threads: DataFrame, emails: DataFrame) -> DataFrame:
    return mail_without_thread(threads, emails).groupBy("thread_id").agg(
        F.count("*").alias("email_count"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min("subject").alias("subject"), F.count_distinct("from_email").alias("participants")
    )


def repair_actions(threads: DataFrame, emails: DataFrame) -> DataFrame:
    """(thread_id, action, new_id): what to do with each visible thread without mail.

    FIX_ID where a mail with the thread's id (or else its root id) is filed under a thread that has no row; HIDE where
    that thread has a row, or no such mail exists.
    """
    empty = threads_without_mail(threads, emails).select("id", F.col("root_message_id").alias("root"))
    filed = emails.where("message_id is not null").groupBy("message_id").agg(F.min_by("thread_id", "id").alias("filed"))
    by_id = filed.select(F.col("message_id").alias("id"), F.col("filed").alias("by_id"))
    by_root = filed.select(F.col("message_id").alias("root"), F.col("filed").alias("by_root"))
    both = empty.join(by_id, "id", "left").join(by_root, "root", "left")
    target = F.when((F.col("by_id") != "") & (F.col("by_id") != F.col("id")), F.col("by_id")).when((F.col("root") != "") & (F.col("root") != F.col("id")) & (F.col("by_root") != ""), F.col("by_root"))
    rows = threads.select(F.col("id").alias("target"), F.lit(True).alias("has_row"))
    judged = both.select("id", target.alias("target")).join(rows, "target", "left")
    fix = F.col("target").isNotNull() & F.col("has_row").isNull()
    return judged.select(F.col("id").alias("thread_id"), F.when(fix, "FIX_ID").otherwise("HIDE").alias("action"), F.when(fix, F.col("target")).alias("new_id"))


def numbered(df: DataFrame, *key: Column | str) -> DataFrame:
    """df with n, the place of each row in the order of columns that are unique together: ranges are sorted, then offsets are added.

    No partition holds all rows; what is collected is one count for each range.
    """
    from threadloom.tables import cut

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = cut(df.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()))
    sizes = laid.groupBy("_part").agg(F.count("*").alias("size"))
    before = sizes.select("_part", (F.sum("size").over(W.orderBy("_part")) - F.col("size")).alias("before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*key))
    return laid.join(F.broadcast(before), "_part").withColumn("n", (F.col("before") + inside).cast("bigint")).drop("_part", "before")


def cache_lookup(df: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """df (with backend and a text) with cache_key, translated and hit."""
    keyed = df.withColumn("cache_key", F.when(F.col(text).isNotNull(), M.cache_key(F.col("backend"), F.col(text))))
    known = cache.select("cache_key", "translated", F.lit(True).alias("hit"))
    return keyed.join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def within_days(df: DataFrame, owner: str, key: str, at: str, days: int) -> DataFrame:
    """Pairs of rows of one owner at most so many days apart: an equi-join on owner and day bucket, then the exact range.

    Each row is matched with the buckets before, at and after its own, so a hot owner is split by time.
    """
    bucket = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / (86400 * days)).cast("bigint")
    near = df.select(owner, key, at, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    other = df.select(owner, F.col(key).alias("related"), F.col(at).alias("related_at"), bucket.alias("bucket"))
    reach = F.expr(f"interval {days} days")
    return near.join(other, [owner, "bucket"]).where((F.col(key) != F.col("related")) & F.col("related_at").between(F.col(at) - reach, F.col(at) + reach))


def previous(df: DataFrame, owner: str, at: str, key: str) -> DataFrame:
    """(key, previous): the latest row of the same owner strictly before each row; ties go to the largest key."""
    by_time = df.groupBy(owner, at).agg(F.max(key).alias("last"))
    step = by_time.withColumn("previous", F.lag("last").over(W.partitionBy(owner).orderBy(at)))
    return df.join(step.select(owner, at, "previous"), [owner, at]).select(key, "previous")


def hit_rates(paragraphs: DataFrame, cache: DataFrame) -> DataFrame:
    """(backend, lookups, hits, rate): how many paragraphs each back-end of the cache answers. Back-ends are a handful of names."""
    names = cache.where("backend is not null").select("backend").distinct()
    asked = paragraphs.where("text_orig is not null").groupBy("text_orig").agg(F.count("*").alias("n"))
    # each text is hashed for each back-end
    listed = [r[0] for r in names.collect()]
    keys = asked.select("n", F.explode(F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")).alias("backend"), "text_orig")
    keys = keys.select("backend", "n", F.sha2(F.concat_ws(":", "backend", "text_orig"), 256).alias("cache_key"))
    held = cache.select("cache_key", F.lit(True).alias("held"))
    out = keys.join(held, "cache_key", "left").groupBy("backend").agg(F.sum("n").alias("lookups"), F.coalesce(F.sum(F.when(F.col("held"), F.col("n"))), F.lit(0)).alias("hits"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("lookups"), 6))

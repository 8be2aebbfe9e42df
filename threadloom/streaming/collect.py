"""Incremental collection: a file stream of mails into the store, with a queue of threads to fetch.

A micro-batch filters mails by rules, takes the first mail of each thread root, and enqueues roots that aren't queued;
all steps are keyed, so a batch that runs twice changes nothing. What failed is tried again, three attempts in all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions import mailtext as M
from threadloom.operators import knowledge as K
from threadloom.operators.store import KnowledgeBase

ATTEMPTS = 3


def root_of(refs: F.Column, message_id: F.Column) -> F.Column:
    """The first reference, else the mail's own id."""
    return F.coalesce(F.get(refs, 0), message_id)


def queue_rows(mails: DataFrame, job: int, now: float, keywords: list[str], unwanted: list[str] | None = None, subsystem: list[str] | None = None, topic: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """Mails that pass the rule filter, the first of each root, as queue items; `budget` bounds how many."""
    kept = mails.where(M.wanted(F.col("subject"), F.col("body"), keywords, unwanted, subsystem, topic)).withColumn("root_message_id", root_of(F.col("references"), F.col("message_id")))
    kept = kept.where("root_message_id <> ''").withColumn("_at", F.struct(F.coalesce("input_pos", F.lit(0)), "message_id"))
    first = K.first_write(kept, ["root_message_id"], ["_at"])
    items = first.select(
        F.lit(job).cast("bigint").alias("job_id"), "root_message_id", "subject", "source_url", F.lit(0.5).alias("relevance_score"), F.lit("").alias("relevance_reason"), F.lit("pending").alias("status"), F.lit(0).alias("priority"), F.lit(0).alias("retry_count"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")
    )
    return items.orderBy("root_message_id").limit(budget) if budget is not None else items


def start(kb: KnowledgeBase, mails: DataFrame, checkpoint: str, job: int, clock: Callable[[], float], keywords: list[str], list_name: str = "all", **rules: object) -> StreamingQuery:
    """Collects a stream of mails once through (availableNow); restarting goes on where the checkpoint ended."""
    from threadloom.operators.store import mail_rows

    def batch(rows: DataFrame, _: int) -> None:
        now = clock()
        # of mails with one id the first of the input stays
        rows = K.first_write(rows.withColumn("_at", F.struct(F.coalesce("input_pos", F.lit(0)), F.coalesce("date", F.lit("")), F.coalesce("body", F.lit("")))), ["message_id"], ["_at"]).drop("_at").persist()
        kb.enqueue(queue_rows(rows, job, now, keywords, **rules))
        kb.insert_emails(mail_rows(rows.where(M.wanted(F.col("subject"), F.col("body"), keywords, **{k: v for k, v in rules.items() if k != "budget"})), list_name, now))
        rows.unpersist()

    return mails.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work(kb: KnowledgeBase, job: int, fetch: Callable[[DataFrame], DataFrame], clock: Callable[[], float], at_once: int = 100) -> dict[str, int]:
    """Fetches the pending items of a job until none is left; gives the final counts.

    fetch takes items and gives (root_message_id, ok). Items left as `downloading` by a run that died are taken first.
    """
    kb.write("collect_queue", kb.read("collect_queue").withColumn("status", F.when((F.col("job_id") == job) & (F.col("status") == "downloading"), "pending").otherwise(F.col("status"))))
    while True:
        queue = kb.read("collect_queue").where((F.col("job_id") == job) & ((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_count") < ATTEMPTS))))
        items = queue.orderBy(F.desc("priority"), "created_at", "id").limit(at_once).persist()
        if items.isEmpty():
            break
        kb.set_queue_status(items.select("job_id", "root_message_id", F.lit("downloading").alias("status"), "retry_count", F.lit(clock()).alias("updated_at")))
        done = items.select("job_id", "root_message_id", "retry_count").join(fetch(items), "root_message_id", "left")
        ok = F.coalesce("ok", F.lit(False))
        kb.set_queue_status(done.select("job_id", "root_message_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(ok, F.col("retry_count")).otherwise(F.col("retry_count") + 1).alias("retry_count"), F.lit(clock()).alias("updated_at")))
        items.unpersist()
    row = K.queue_stats(kb.read("collect_queue").where(F.col("job_id") == job)).first()
    return {k: row[k] for k in (*K.STATES, "total")} if row else dict.fromkeys((*K.STATES, "total"), 0)


def unfinished(threads: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The threads that a run still has to do: those without a page, and, where sources (id, source_hash) and a column
    source_hash of threads are given, those whose source has changed."""
    blank = F.coalesce(F.trim("translated_html_path"), F.lit("")) == ""
    if sources is None:
        return threads.where(blank)
    same = sources.select("id", F.col("source_hash").alias("_now"))
    return threads.join(same, "id", "left").where(blank | ~F.col("source_hash").eqNullSafe(F.col("_now"))).drop("_now")


def read_mail_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON mails that arrive as files."""
    kinds = "subject string, `from` string, date string, body string, message_id string, in_reply_to string, `references` array<string>, source_url string, input_pos bigint"
    return spark.readStream.schema(kinds).json(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts of a stream of mails by list and hour of arrival, with a watermark for late ones."""
    return events.withWatermark("at", late).groupBy(F.window("at", size), "list_name").agg(F.count("*").alias("n"))

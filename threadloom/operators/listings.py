"""Filters, orders and totals of mail and card listings, and the texts that back-ends are asked with."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M
from threadloom.operators.knowledge import numbered

#: Longest diff (characters) that is translated with a mail.
DIFF_SIZE = 8192


def _has(word: str, *columns: Column) -> Column:
    return reduce(or_, [F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(word.lower())) for x in columns])


def mail_filter(mails: DataFrame, query: str = "", author: str = "", tag: str = "", preview: int = 200) -> DataFrame:
    """The mails whose author, subject or preview has the query and whose author and tag are the wanted ones; blank
    conditions hold for all."""
    hit = _has(query, F.col("from_name"), F.col("subject"), F.substring("body", 1, preview)) & _has(author, F.col("from_name"))
    return mails.where(hit & (M.tag_of_row(F.col("priority"), F.col("subject")) == tag if tag else F.lit(True)))


def card_filter(cards: DataFrame, query: str = "", tag: str = "", processed: int | None = None) -> DataFrame:
    """The threads whose subject, summary or tags have the query, with a tag and of a state."""
    hit = _has(query, F.col("subject"), F.col("summary_zh"), F.col("tags"))
    if tag:
        hit &= F.exists(M.json_list(F.col("tags")), lambda x: F.trim(x) == tag)
    return cards.where(hit if processed is None else hit & (F.col("processed") == processed))


#: The orders of a card listing, each with the id after it.
ORDERS = {"date": lambda: F.desc_nulls_last("end_date"), "mails": lambda: F.desc_nulls_last("email_count"), "subject": lambda: F.coalesce("subject", F.lit(""))}


def sorted_cards(cards: DataFrame, mode: str = "date") -> DataFrame:
    """cards with place, numbered in an order; places come from the sizes of range partitions, not from one task."""
    order = ORDERS.get(mode, ORDERS["date"])()
    return numbered(cards, order, "id").withColumnRenamed("n", "place")


def totals(cards: DataFrame, size: str, done: Column, group: str) -> DataFrame:
    """(cards, mails, translated, areas) of a listing, as one row."""
    return cards.agg(F.count("*").alias("cards"), F.coalesce(F.sum(size), F.lit(0)).alias("mails"), F.count_if(done).alias("translated"), F.count_distinct(group).alias("areas"))


def small_diffs(mails: DataFrame, size: int = DIFF_SIZE) -> DataFrame:
    """mails with diff_size where a diff begins and is not too long to be translated."""
    diff = F.length("body") - F.instr("body", "diff --git ") + 1
    return mails.where(F.contains("body", F.lit("diff --git "))).withColumn("diff_size", diff).where(F.col("diff_size") <= size)


def thread_prompts(mails: DataFrame, root: int, replies: int, size: int) -> DataFrame:
    """(thread_id, text): the first stored mail of each thread and so many replies, each cut.

    Places are given to ids alone, and the limit on them is taken over before the shuffle (a window group limit), so a hot
    thread is a few rows a task; bodies are joined to those ids only.
    """
    filed = mails.where("thread_id <> ''")
    place = F.row_number().over(W.partitionBy("thread_id").orderBy("id"))
    wanted = filed.select("thread_id", "id", (place - 1).alias("pos")).where(F.col("pos") <= replies)
    rows = wanted.join(filed.select("id", "subject", "from_name", "body"), "id")
    shown = F.substring(F.coalesce("body", F.lit("")), F.lit(1), F.when(F.col("pos") == 0, root).otherwise(size))
    head = F.when(F.col("pos") == 0, F.concat(F.lit("# "), F.coalesce("subject", F.lit("")), F.lit("\n"))).otherwise("")
    part = F.concat(head, F.lit("["), F.coalesce("from_name", F.lit("")), F.lit("]\n"), shown)
    parts = rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("text")))).alias("parts"))
    return parts.select("thread_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))


def timeouts(mails: DataFrame) -> DataFrame:
    """(thread_id, thread_seconds, mail_seconds): how long a back-end may take over a thread and over its longest mail."""
    # Seconds at least, for each mail or kilobyte, and at most.
    size = F.length(F.coalesce("body", F.lit("")))
    mail = F.least(F.lit(60) + 10 * F.floor(size / 1024), F.lit(300))
    return mails.where("thread_id <> ''").groupBy("thread_id").agg(F.least(F.lit(120) + 60 * F.count("*"), F.lit(1800)).alias("thread_seconds"), F.max(mail).alias("mail_seconds"))

"""A versioned Parquet store with the update rules of the knowledge base.

Parquet tables can't be updated in place, so each change computes the next version of a table and then creates a marker of
that version; the highest marker is the current version and nothing is ever deleted first, so a writer that dies between any
two steps leaves the version before. Readers keep the version they opened. There is one writer. What is only added goes
into a further folder beside those of the version before, so a micro-batch writes its own rows alone. Every rule is a function from the old rows and the new
rows to the next rows (a join on the key), so rules can be tested and reused without files.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import mailtext as M
from threadloom.operators import knowledge as K
from threadloom.tables import clean, cut

#: Folders of added rows in one version.
FOLDERS = 64


def _ids(new: DataFrame, old: DataFrame, key: str, order: list[str]) -> DataFrame:
    """new with ids above the largest one of old, in the order of unique columns."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    placed = K.numbered(new.withColumn("_order", F.struct(*order)), "_order").drop("_order")
    return placed.join(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("n")).drop("_top", "n")


def mail_rows(parsed: DataFrame, list_name: str, now: float) -> DataFrame:
    """Parsed mails as rows of emails: ids stripped, the sender's name cut off, refs joined, blank ids left out."""
    refs = F.array_join("references", " ")
    score = F.col("relevance_score") if "relevance_score" in parsed.columns else F.lit(None).cast("double")
    reason = F.col("relevance_reason") if "relevance_reason" in parsed.columns else F.lit("")
    priority = F.col("priority") if "priority" in parsed.columns else F.lit("")
    return parsed.select(
        clean(F.col("message_id")).alias("message_id"), "subject", M.stored_name(F.col("from")).alias("from_name"), F.col("from").alias("from_email"), "date", "body", F.lit(list_name).alias("list_name"), F.coalesce("thread_id", F.lit("")).alias("thread_id") if "thread_id" in parsed.columns else F.lit("").alias("thread_id"),
        clean(F.coalesce("in_reply_to", F.lit(""))).alias("in_reply_to"), refs.alias("refs"), priority.alias("priority"), score.alias("relevance_score"), reason.alias("relevance_reason"), F.lit("").alias("raw_json_path"), F.lit(0).alias("processed"), F.lit(now).alias("created_at"),
    ).where("message_id <> ''")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], key_column: str | None = "id") -> DataFrame:
    """The rows of new whose key isn't held, the first of each key; with ids if the table has them. First write wins."""
    fresh = K.first_write(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return _ids(fresh, old, key_column, keys).select(*old.columns) if key_column else fresh.select(*old.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], changed: dict[str, Column] | list[str]) -> DataFrame:
    """All rows after `insert ... on conflict do update`: held keys take the changed columns, others are added.

    changed names the columns taken from new, or gives an expression over columns of old and of new (prefixed `new_`).
    """
    rules = changed if isinstance(changed, dict) else {c: F.col(f"new_{c}") for c in changed}
    last = K.last_write(new, keys, ["created_at"] if "created_at" in new.columns else keys)
    named = last.select(*keys, *[F.col(c).alias(f"new_{c}") for c in last.columns if c not in keys], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(named, keys, "full")
    held = F.coalesce("_old", F.lit(False))
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        else:
            fresh = F.col(f"new_{c}") if f"new_{c}" in both.columns else F.lit(None)
            kept = F.when(F.coalesce("_new", F.lit(False)), rules[c]).otherwise(F.col(c)) if c in rules else F.col(c)
            columns.append(F.when(held, kept).otherwise(fresh).cast(old.schema[c].dataType).alias(c))
    return both.select(*columns)


def update(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], also: dict[str, object] | None = None) -> DataFrame:
    """All rows after an update of held keys only; `also` sets further columns to constants."""
    named = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    both = old.join(named, keys, "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns} | {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (also or {}).items()}
    return both.withColumns(out).select(*old.columns)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def migrate(df: DataFrame, schema: str) -> DataFrame:
    """df with all columns of a schema; those that are missing are null (hidden is 0)."""
    want = df.sparkSession.createDataFrame([], schema).schema
    missing = {f.name: (F.lit(0) if f.name == "hidden" else F.lit(None)).cast(f.dataType) for f in want if f.name not in df.columns}
    return df.withColumns(missing).select(*want.names) if missing else df.select(*want.names)


SUMMARY_FIELDS = ["summary_zh", "key_points", "consensus", "design_decisions", "related_files", "related_functions", "tags"]


class KnowledgeBase:
    """The store at a path: reading gives DataFrames, writing makes the next version of a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._Path = hadoop.Path

    def _markers(self, table: str) -> list[str]:
        folder = self._Path(f"{self.path}/{table}")
        if not self._fs.exists(folder):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(folder)]

    def version(self, table: str) -> int:
        """The highest version with a marker; 0 where there is none."""
        return max([int(n.removeprefix("_committed.")) for n in self._markers(table) if n.startswith("_committed.")], default=0)

    def _parts(self, table: str, n: int) -> list[int]:
        """The folders a version consists of."""
        stream = self._fs.open(self._Path(f"{self.path}/{table}/_committed.{n:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        if n := self.version(table):
            kind = self.spark.createDataFrame([], schemas.TABLES[table]).schema
            parts = [self.spark.read.parquet(f"{self.path}/{table}/v={k}") for k in self._parts(table, n)]
            whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            return migrate(whole, schemas.TABLES[table]) if whole.schema != kind else whole
        return self.spark.createDataFrame([], schemas.TABLES[table])

    def write(self, table: str, rows: DataFrame, parts: list[int] | None = None) -> int:
        """The next version: rows, beside the folders of `parts`."""
        taken = [int(n.removeprefix("v=")) for n in self._markers(table) if n.startswith("v=")]
        n = max([self.version(table), *taken]) + 1  # also above what a writer that died left behind
        rows.select(*self.read(table).columns).write.mode("overwrite").parquet(f"{self.path}/{table}/v={n}")
        self._commit(table, n, [*(parts or []), n])
        return n

    def _commit(self, table: str, n: int, parts: list[int]) -> None:
        """The marker of a version, made whole under another name and then renamed, which is one step."""
        made, marker = self._Path(f"{self.path}/{table}/_next.{n:010d}"), self._Path(f"{self.path}/{table}/_committed.{n:010d}")
        stream = self._fs.create(made, True)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        if not self._fs.rename(made, marker):
            raise OSError(f"version {n} of {table} is there already")

    def _append(self, table: str, fresh: DataFrame) -> int:
        """Adds rows as further files; after FOLDERS of them the table is written anew."""
        fresh = cut(fresh)
        added = fresh.count()
        if added:
            now = self.version(table)
            parts = self._parts(table, now) if now else []
            if len(parts) < FOLDERS:
                self.write(table, fresh, parts)
            else:
                self.write(table, self.read(table).unionByName(fresh))
        return added

    def insert_emails(self, rows: DataFrame) -> tuple[int, int]:
        """(new, skipped): mails whose id is held are left out."""
        total = rows.count()
        added = self._append("emails", insert_ignore(self.read("emails"), rows, ["message_id"], ["created_at", "subject", "from_email", "body"]))
        return added, total - added

    def upsert_threads(self, rows: DataFrame) -> int:
        """New threads are added; of held ones only subject and the two counts change, never the dates."""
        return self.write("threads", upsert(self.read("threads"), rows, ["id"], ["subject", "email_count", "participant_count"]))

    def update_summaries(self, rows: DataFrame) -> int:
        return self.write("threads", update(self.read("threads"), rows, ["id"], SUMMARY_FIELDS, {"processed": 1}))

    def set_hidden(self, ids: DataFrame, hidden: int = 1) -> int:
        return self.write("threads", update(self.read("threads"), ids, ["id"], [], {"hidden": hidden}))

    def set_translated_path(self, rows: DataFrame) -> int:
        return self.write("threads", update(self.read("threads"), rows, ["id"], ["translated_html_path"]))

    def insert_report(self, topic: str, content: str, thread_ids: list[str], kind: str, now: float) -> int:
        row = self.spark.createDataFrame([(topic, kind, content, json.dumps(thread_ids), now)], "topic string, report_type string, content string, source_thread_ids string, created_at double")
        old = self.read("knowledge_reports")
        return self._append("knowledge_reports", _ids(row, old, "id", ["created_at", "topic"]).select(*old.columns))

    def enqueue(self, items: DataFrame) -> int:
        """Items of a job whose root isn't queued yet; gives the number really added."""
        return self._append("collect_queue", insert_ignore(self.read("collect_queue"), items, ["job_id", "root_message_id"], ["created_at", "subject"]))

    def set_queue_status(self, items: DataFrame) -> int:
        return self.write("collect_queue", update(self.read("collect_queue"), items, ["job_id", "root_message_id"], ["status", "retry_count", "updated_at"]))

    def reset_queue(self) -> int:
        return self.write("collect_queue", K.reset_queue(self.read("collect_queue")))

    def delete_queue(self, jobs: DataFrame) -> int:
        return self.write("collect_queue", delete(self.read("collect_queue"), jobs, ["job_id"]))

    def create_job(self, job: DataFrame) -> int:
        old = self.read("collect_jobs")
        return self._append("collect_jobs", _ids(migrate(job, schemas.JOBS), old, "id", ["keywords", "created_at"]).select(*old.columns))

    def update_job(self, changes: DataFrame) -> int:
        """Any columns of jobs, by id."""
        return self.write("collect_jobs", update(self.read("collect_jobs"), changes, ["id"], [c for c in changes.columns if c != "id"]))

    def upsert_topics(self, rows: DataFrame) -> int:
        """By name; a blank description or keyword list keeps what is there."""
        keep = lambda c: F.when(F.coalesce(F.col(f"new_{c}"), F.lit("")) == "", F.col(c)).otherwise(F.col(f"new_{c}"))
        old = self.read("topics")
        fresh = _ids(rows.join(old.select("name"), "name", "left_anti").drop("id"), old, "id", ["name"]).select(*old.columns)
        held = rows.join(old.select("name"), "name", "left_semi")
        return self.write("topics", upsert(old, held, ["name"], {c: keep(c) for c in ("display_name", "description", "keywords")}).unionByName(fresh))

    def link_topics(self, links: DataFrame) -> int:
        """Last write wins for each thread and topic."""
        keys = ["thread_id", "topic_id"]
        last = K.last_write(links, keys, ["created_at", "confidence"])
        return self.write("thread_topics", self.read("thread_topics").join(last.select(*keys), keys, "left_anti").unionByName(last.select(*self.read("thread_topics").columns)))

    def auto_topics(self, answers: DataFrame, now: float) -> int:
        """Topics that summary answers (thread_id, topics array, confidence) name are added if they are new and linked to
        their threads; gives the number of links. Blank names are left out."""
        named = answers.select("thread_id", F.explode("topics").alias("name"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")).withColumn("name", clean(F.col("name"))).where("name <> ''")
        named = cut(named.groupBy("thread_id", "name").agg(F.max("confidence").alias("confidence")))
        rows = named.select("name").distinct().select("name", F.col("name").alias("display_name"), F.lit("").alias("description"), F.lit("").alias("keywords"), F.lit(now).alias("created_at"))
        self.upsert_topics(rows.withColumn("id", F.lit(None).cast("bigint")))
        links = cut(named.join(self.read("topics").select("name", F.col("id").alias("topic_id")), "name").select("thread_id", "topic_id", "confidence", F.lit(now).alias("created_at")))
        self.link_topics(links)
        return links.count()

    def open_job(self, keywords: str, now: float) -> int:
        """The latest job of the same keywords that isn't done, else a new one."""
        held = self.read("collect_jobs").where((F.col("keywords") == keywords) & (F.col("status") != "done")).agg(F.max("id")).first()[0]
        if held is not None:
            return held
        self.create_job(self.spark.createDataFrame([(keywords, "pending", now, now)], "keywords string, status string, created_at double, updated_at double"))
        return self.read("collect_jobs").where(F.col("keywords") == keywords).agg(F.max("id")).first()[0]

    def store_thread(self, mails: DataFrame, list_name: str, now: float) -> tuple[int, int]:
        """(new mails, threads): downloaded mails (with thread_id) are inserted and their threads upserted with counts, dates
        and the root's subject."""
        rows = cut(mail_rows(mails, list_name, now))
        added, _ = self.insert_emails(rows)
        root = F.struct(F.col("message_id") != F.col("thread_id"), "date", "message_id")
        threads = rows.where("thread_id <> ''").groupBy(F.col("thread_id").alias("id")).agg(
            F.min_by("message_id", root).alias("root_message_id"), F.min_by("subject", root).alias("subject"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count_distinct("message_id").alias("email_count"), F.count_distinct("from_email").alias("participant_count")
        )
        threads = cut(migrate(threads.withColumns({"created_at": F.lit(now), "processed": F.lit(0)}), schemas.THREADS))
        self.upsert_threads(threads)
        return added, threads.count()

    def put_cache(self, rows: DataFrame) -> int:
        """Replaces; a replaced entry starts again with one access."""
        last = K.last_write(rows.withColumn("access_count", F.lit(1)), ["cache_key"], ["created_at"])
        return self.write("cache", self.read("cache").join(last.select("cache_key"), "cache_key", "left_anti").unionByName(last.select(*self.read("cache").columns)))

    def clear_cache(self, backend: str | None = None) -> int:
        return self.write("cache", self.read("cache").where(F.col("backend") != backend) if backend else self.read("cache").limit(0))

    def repair(self, now: float) -> int:
        """Applies the repair plan: renamed and hidden threads, and rows for mail groups without one."""
        threads, emails = self.read("threads"), self.read("emails")
        plan = K.repair_actions(threads, emails).select(F.col("thread_id").alias("id"), "action", "new_id")
        fixed = threads.join(plan, "id", "left")
        fixed = fixed.withColumns({"hidden": F.when(F.col("action") == "HIDE", 1).otherwise(F.col("hidden")), "root_message_id": F.coalesce("new_id", "root_message_id"), "id": F.coalesce("new_id", "id")}).select(*threads.columns)
        fixed = K.first_write(fixed, ["id"], ["created_at", "subject"])
        made = K.repair_create(threads, emails).select(F.col("thread_id").alias("id"), F.col("thread_id").alias("root_message_id"), "subject", "start_date", "end_date", "email_count", F.col("participants").alias("participant_count"), F.lit(now).alias("created_at"), F.lit(0).alias("processed"))
        made = migrate(made, schemas.THREADS).join(fixed.select("id"), "id", "left_anti")
        return self.write("threads", fixed.unionByName(made))

    def sql(self, query: str) -> DataFrame:
        """Ad-hoc SQL over the tables as views; only queries that read are allowed."""
        import re

        if not re.match(r"(?is)\s*(?:with|select|values|from|show|describe|explain)\b", query):
            raise ValueError("only queries that read are allowed")
        for table in schemas.TABLES:
            self.read(table).createOrReplaceTempView(table)
        return self.spark.sql(query)

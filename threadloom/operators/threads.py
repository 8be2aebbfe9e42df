"""Discussion threads: reply trees, roots, aggregates, subject trees with as-of repair of orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M
from threadloom.operators import hierarchy, timestamps
from threadloom.tables import cut, one_form


def mails(emails: DataFrame) -> DataFrame:
    """One row for each message id (the first stored), ids in one form, refs as array, sent_at as instant."""
    refs = F.filter(F.transform(F.split("refs", r"[\s,]+"), one_form), lambda r: r.isNotNull())
    rows = emails.select(
        F.col("id"), one_form("message_id").alias("mid"), one_form("in_reply_to").alias("reply"), F.coalesce(refs, F.array().cast("array<string>")).alias("refs"), one_form("thread_id").alias("thread"), "subject", "from_name", "from_email", "date", "created_at"
    ).where("mid is not null")
    first = rows.groupBy("mid").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "mid"]), "id").alias("m")).select("mid", "m.*")
    return timestamps.normalise(first, "date", F.lit("emails.date")).withColumn("sent_at", F.timestamp_micros("utc_us")).drop("utc_us", "guess_us", "layout", "posterior", "state")


def replies(rows: DataFrame, strict_refs: bool = False) -> DataFrame:
    """(node, parent, place): the parent is in_reply_to, else the last of refs; a parent that isn't held makes a root.

    A mail without in_reply_to that no mail's refs name is a root, also if it has refs itself; strict_refs=True
    attaches it to its last reference instead.
    """
    named = rows.select(F.explode("refs").alias("mid")).distinct().withColumn("named", F.lit(True))
    held = rows.select(F.col("mid").alias("parent"), F.lit(True).alias("held"))
    wanted = F.coalesce("reply", F.when(F.lit(strict_refs) | F.coalesce("named", F.lit(False)), F.element_at("refs", -1)))
    linked = rows.join(named, "mid", "left").withColumn("parent", F.when(F.size("refs") > 0, wanted).otherwise(F.col("reply")))
    linked = linked.join(held, "parent", "left")
    return linked.select(F.col("mid").alias("node"), F.when(F.col("held"), F.col("parent")).alias("parent"), F.concat_ws("|", F.coalesce("thread", "mid"), F.lpad(F.col("id").cast("string"), 20, "0")).alias("place"))


def build(emails: DataFrame, strict_refs: bool = False) -> DataFrame:
    """(mid, parent, root, depth, id, sent_at, from_email, subject) of each mail; mails on circles are filed under the smallest id."""
    rows = cut(mails(emails))
    solved = hierarchy.resolve(cut(replies(rows, strict_refs)))
    return rows.join(solved.select(F.col("node").alias("mid"), "parent", "root", F.greatest("depth", F.lit(0)).cast("int").alias("depth")), "mid").select("mid", "parent", "root", "depth", "id", "sent_at", "from_email", "subject")


def summaries(built: DataFrame) -> DataFrame:
    """One row for each thread: root, mails, participants, first and last instant. Unreadable dates don't count."""
    return built.groupBy("root").agg(F.count("*").alias("email_count"), F.array_sort(F.collect_set("from_email")).alias("participants"), F.min("sent_at").alias("start_at"), F.max("sent_at").alias("end_at"))


def overview(built: DataFrame) -> DataFrame:
    return built.agg(F.count_distinct("root").alias("threads"), F.count("*").alias("mails"), F.count_distinct("from_email").alias("participants"))


def busiest(built: DataFrame, k: int = 10) -> DataFrame:
    """The participants of most threads."""
    return built.where("from_email is not null").select("root", "from_email").distinct().groupBy("from_email").agg(F.count("*").alias("threads")).orderBy(F.desc("threads"), "from_email").limit(k)


def first_n(built: DataFrame, n: int) -> DataFrame:
    """The first n mails of each thread by date, root first."""
    w = W.partitionBy("root").orderBy("depth", F.asc_nulls_first("sent_at"), "id")
    return built.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def subject_tree(emails: DataFrame) -> DataFrame:
    """(id, group, parent_id, how): mails grouped by subject, each hung on its parent.

    how: `reply` to a mail of the group; `quoted`, the latest earlier mail of the group by whom the body's reply line
    names; `time`, the latest root of the group not after it (or else the first root); `root`. Order is that of the
    stored date text, as in the listing. Partners are found by as-of windows, not by pairs.
    """
    keyed = emails.select("id", one_form("message_id").alias("mid"), one_form("in_reply_to").alias("reply"), F.coalesce("date", F.lit("")).alias("date"), F.lower(F.coalesce("from_email", F.lit(""))).alias("sender"), M.group_subject(F.col("subject")).alias("group"), M.reply_depth(F.col("subject")).alias("depth"), M.reply_target(F.col("body")).alias("target"))
    rows = cut(keyed)
    parents = rows.where("mid is not null").groupBy("group", F.col("mid").alias("reply")).agg(F.max("id").alias("parent_id"))
    linked = rows.join(parents, ["group", "reply"], "left")
    state = F.when(F.col("parent_id").isNotNull() & F.col("reply").isNotNull(), "reply").when(F.col("depth") == 0, "root").otherwise("orphan")
    linked = cut(linked.withColumn("how", state))
    # the latest earlier mail of the group whose sender the reply line names: senders are matched by address or first name
    orphans = linked.where("how = 'orphan'").select("id", "group", "date", "target")
    names = rows.select(F.col("id").alias("cand"), "group", F.col("date").alias("cand_date"), F.explode(F.array_distinct(F.array(F.regexp_extract("sender", "<([^>]+)>", 1), F.trim(F.split_part("sender", F.lit("<"), F.lit(1)))))).alias("target")).where("target <> ''")
    both = orphans.where("target <> ''").select("group", "target", "date", "id", F.lit(None).cast("bigint").alias("cand")).unionByName(names.select("group", "target", F.col("cand_date").alias("date"), F.lit(None).cast("bigint").alias("id"), "cand"))
    by_day = both.groupBy("group", "target", "date").agg(F.max("cand").alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("group", "target").orderBy("date").rowsBetween(W.unboundedPreceding, -1))
    quoted = orphans.join(by_day.withColumn("quoted_id", before), ["group", "target", "date"]).select("id", "quoted_id").where("quoted_id is not null")
    # the latest root not after the orphan, else the first root, else the earliest orphan
    still = linked.join(quoted, "id", "left")
    roots = still.where("how = 'root'").groupBy("group", "date").agg(F.max("id").alias("root_id"))
    days = still.where("how = 'orphan' and quoted_id is null").select("group", "date").distinct()
    line = days.withColumn("root_id", F.lit(None).cast("bigint")).unionByName(roots).groupBy("group", "date").agg(F.max("root_id").alias("root_id"))
    group = W.partitionBy("group").orderBy("date")
    line = line.select("group", "date", F.coalesce(F.last("root_id", ignorenulls=True).over(group), F.first("root_id", ignorenulls=True).over(W.partitionBy("group").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("time_id"))
    out = still.join(line, ["group", "date"], "left")
    eldest = still.groupBy("group").agg(F.min_by("id", F.struct("date", "id")).alias("eldest"), F.count_if(F.col("how") == "root").alias("roots"))
    out = out.join(eldest, "group")
    timed = F.when(F.col("roots") > 0, F.col("time_id")).when(F.col("id") != F.col("eldest"), F.col("eldest"))
    parent = F.when(F.col("how") == "reply", F.col("parent_id")).when(F.col("how") == "orphan", F.coalesce("quoted_id", timed))
    how = F.when(F.col("how") != "orphan", F.col("how")).when(F.col("quoted_id").isNotNull(), "quoted").when(timed.isNotNull(), "time").otherwise("root")
    return out.select("id", "group", parent.alias("parent_id"), how.alias("how"))

"""Context documents: sections of a commit, its diff and the mails about it; packing, parsing and trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M
from threadloom.operators.knowledge import numbered
from threadloom.tables import clean

# The separators and headings of a context document.
RULE = "=" * 70
MAIL_HEAD = r"(?m)^(={70}\n# Lore 邮件线程.*?\n={70}\n(?:# \[HIGH:.*\n)?)"
TAIL_HEAD = r"\n={70}\n# (?:分析任务清单|请基于以上内容)"
KEYS = ["Hash", "Subject", "Author", "Date", "Files", "Subsys", "Lore", "Patchset"]
LIMITS = {1: 500, 2: 2000, 3: 5000}
CUT = "\n... [正文已截断]"
SPARE = 200


def sections(text: Column) -> Column:
    """struct(header, blocks, footer): header and footer of a document, and its mail blocks in order."""
    head = F.regexp_extract(text, MAIL_HEAD, 1)
    start = F.instr(text, head)
    rest = F.substring(text, start + F.length(head), F.length(text))
    body = F.split(rest, TAIL_HEAD, 2)[0]
    tail = F.when(F.length(body) < F.length(rest), F.substring(rest, F.length(body) + 2, F.length(rest))).otherwise("")
    blocks = F.filter(F.transform(F.split(body, r"\n(?=## \[)"), clean), lambda b: b != "")
    found = head != ""
    return F.struct(
        F.when(found, F.substring(text, F.lit(1), start + F.length(head) - 1)).otherwise(text).alias("header"), F.when(found, blocks).otherwise(F.array().cast("array<string>")).alias("blocks"), F.when(found, tail).otherwise("").alias("footer")
    )


def mail_block(block: Column) -> Column:
    """struct(tag, subject, from, date, message_id, in_reply_to, body) of one block."""
    field = lambda name: F.trim(F.regexp_extract(block, rf"(?m)^{name}\s*:\s*(.+)$", 1))
    tag = F.regexp_extract(block, r"^## (\[[^\]]+\])\s*(.*)", 1)
    subject = F.when(tag != "", F.regexp_extract(block, r"^## (\[[^\]]+\])\s*(.*)", 2)).otherwise(F.split(block, "\n")[0])
    lines = F.split(block, "\n")
    last = F.array_max(F.transform(lines, lambda x, k: F.when(x.rlike(r"^(?:From|Date|Message-Id|In-Reply-To)\s*:\s*\S"), k + 1).otherwise(0)))
    body = F.when(last > 0, clean(F.array_join(F.slice(lines, last + 1, F.greatest(F.lit(1), F.size(lines))), "\n"))).otherwise("")
    return F.struct(tag.alias("tag"), subject.alias("subject"), field("From").alias("from"), field("Date").alias("date"), field("Message-Id").alias("message_id"), field("In-Reply-To").alias("in_reply_to"), body.alias("body"))


def parse(df: DataFrame, column: str = "content") -> DataFrame:
    """df with commit (map), diff, emails (array) and checklist of each document."""
    text = F.col(column)
    commit = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k.lower()) for k in KEYS]), F.array(*[F.trim(F.regexp_extract(text, rf"(?m)^{k}\s*:\s*(.+)$", 1)) for k in KEYS])), lambda _, v: v != "")
    diff = clean(F.regexp_extract(text, r"(?s)## 代码变更 \(diff\)\n```diff\n(.+?)```", 1))
    checklist = clean(F.regexp_extract(text, r"(?s)(={70}\n# (?:分析任务清单|请基于以上内容).*)", 1))
    return df.withColumns({"commit": commit, "diff": diff, "emails": F.transform(sections(text)["blocks"], mail_block), "checklist": checklist})


def trim(df: DataFrame, size: int = 100_000, column: str = "content") -> DataFrame:
    """df with the document cut to a size: mails are cut by their label, then taken greedily, the most valued first.

    A document that fits stays; one without mails is cut hard; if header and footer alone are too long only they stay.
    """
    text = F.col(column)
    # a generator keeps the sections as columns, so that their patterns run once
    found = sections(text)
    rows = df.select("*", F.inline(F.array(F.struct(found["header"].alias("_header"), found["blocks"].alias("_blocks"), found["footer"].alias("_footer")))))
    blocks = F.transform("_blocks", lambda b, k: F.struct((-M.trim_order(F.regexp_extract(b, r"^## (\[[^\]]+\])", 1))).alias("order"), k.alias("pos"), b.alias("block")))
    limit = lambda order: F.when(order == -1, LIMITS[1]).when(order == -2, LIMITS[2]).otherwise(LIMITS[3])
    shorter = F.transform(F.array_sort(blocks), lambda b: F.when(F.length(b["block"]) > limit(b["order"]), F.concat(F.substring(b["block"], F.lit(1), limit(b["order"])), F.lit(CUT))).otherwise(b["block"]))
    budget = F.lit(size - SPARE) - F.length("_header") - F.length("_footer")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda acc, b: acc["used"] + F.length(b) + 2 <= F.col("_budget")
    packed = F.aggregate("_short", start, lambda acc, b: F.struct(F.when(fits(acc, b), acc["used"] + F.length(b) + 2).otherwise(acc["used"]).alias("used"), F.when(fits(acc, b), F.array_append(acc["kept"], b)).otherwise(acc["kept"]).alias("kept")))
    rows = rows.withColumns({"_short": shorter, "_budget": budget}).withColumn("_kept", packed["kept"])
    total, kept = F.size("_blocks"), F.size("_kept")
    note = F.concat(F.lit("\n\n... [已展示 "), kept.cast("string"), F.lit("/"), total.cast("string"), F.lit(" 封邮件，"), (total - kept).cast("string"), F.lit(" 封因字符限制被省略]"))
    parts = F.concat(F.array("_header"), F.transform("_kept", lambda b: F.concat(F.lit("\n"), b)), F.when(kept < total, F.array(note)).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("\n"), "_footer")))
    out = F.when(F.length(text) <= size, text).when(total == 0, F.substring(text, 1, size)).when(F.col("_budget") <= 0, F.concat("_header", F.lit("\n"), "_footer")).otherwise(F.array_join(parts, "\n"))
    some = (F.length(text) > size) & (total > 0) & (F.col("_budget") > 0)
    return rows.withColumns(
        {
            "original_size": F.length(text).cast("bigint"),
            "emails_total": total.cast("bigint"),
            "emails_kept": F.when(some, kept).when(F.length(text) <= size, total).otherwise(0).cast("bigint"),
            "trimmed": F.length(text) > size,
            column: out,
        }
    ).withColumns({"trimmed_size": F.length(column).cast("bigint"), "emails_dropped": F.col("emails_total") - F.col("emails_kept")}).drop("_header", "_blocks", "_footer", "_short", "_budget", "_kept")


#: Mails in one part of a document.
PART = 500


def pack(commits: DataFrame, mails: DataFrame) -> DataFrame:
    """(hash, part, content): a context document for each commit, from its row and the mails joined to it by hash, in parts
    of PART mails, so that no row holds all mails of a hot commit. Mails are placed by range partitions.

    mails: hash, priority, input_pos, subject, from, date, message_id, in_reply_to, body. The most valued mails come first.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    tag = M.tag_of_priority(F.col("priority"))
    block = F.concat_ws("\n", F.concat(F.lit("## "), tag, F.lit(" "), F.coalesce("subject", F.lit(""))), line("From", F.col("from")), line("Date", F.col("date")), line("Message-Id", F.col("message_id")), line("In-Reply-To", F.col("in_reply_to")), F.lit(""), F.coalesce("body", F.lit("")))
    laid = numbered(mails.select("hash", (-F.col("priority")).alias("order"), "input_pos", block.alias("block")), "hash", "order", "input_pos")
    start = laid.groupBy("hash").agg(F.min("n").alias("start"))
    laid = laid.join(start, "hash").withColumn("part", F.expr(f"(n - start) div {PART}"))
    blocks = laid.groupBy("hash", "part").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("blocks"))
    head = F.concat_ws("\n", F.lit(RULE), F.concat(F.lit("# COMMIT "), "hash"), F.lit(RULE), line("Hash", F.col("hash")), line("Subject", F.col("subject")), line("Author", F.col("author")), line("Date", F.col("date").cast("string")), F.lit("## Commit Message"), F.coalesce("body", F.lit("")), F.lit("## 代码变更 (diff)\n```diff"), F.substring(F.coalesce("diff", F.lit("")), 1, 6000), F.lit("```"), F.lit(RULE), F.lit("# Lore 邮件线程"), F.lit(RULE))
    tail = F.concat_ws("\n", F.lit(""), F.lit(RULE), F.lit("# 请基于以上内容"))
    joined = commits.join(blocks, "hash", "left")
    body = F.array_join(F.transform(F.coalesce("blocks", F.array().cast("array<struct<n:bigint,block:string>>")), lambda b: F.concat(F.lit("\n"), b["block"])), "\n")
    return joined.select("hash", F.coalesce("part", F.lit(0)).alias("part"), F.concat_ws("\n", head, body, tail).alias("content"))


def metadata(df: DataFrame, column: str = "content") -> DataFrame:
    """df with commit_hash, author, date, subject, subsystem, patchset and mail counts from a document's first lines."""
    head = F.substring(column, 1, 4096)
    value = lambda *names: F.trim(F.regexp_extract(head, rf"(?m)^(?:{'|'.join(names)})\s*:\s*(.+)$", 1))
    count = lambda word: F.regexp_extract(head, rf"{word} (\d+) 封", 1).try_cast("bigint")
    return df.withColumns({"commit_hash": F.substring(value("Hash", "Commit"), 1, 12), "author": value("Author"), "date": value("Date"), "subject": value("Subject"), "subsystem": value("Subsys", "Subsystem"), "patchset": value("Patchset"), "raw_email_count": count("原始"), "kept_email_count": count("保留")})

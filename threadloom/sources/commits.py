"""Commits from `git show` texts, and what is derived from them: tags, search terms, date windows, related commits."""

from __future__ import annotations

import re
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M

KIND = "hash string, author string, author_email string, date timestamp_ntz, subject string, body string, files array<string>"
_STAT = re.compile(r"\s+([\w/._-]+)\s+\|")


def parse_show(text: str) -> dict:
    """One `git show --stat` text. The date keeps its wall clock and drops its zone."""
    head, _, rest = text.partition("\n\n")
    fields = dict(re.findall(r"(?m)^(commit|Author:|Date:)\s+(.*)$", head))
    who = re.match(r"(.+?)\s+<(.+?)>", fields.get("Author:", ""))
    try:
        date = parsedate_to_datetime(fields["Date:"]).replace(tzinfo=None)
    except (KeyError, ValueError, TypeError):
        date = None
    lines = rest.split("\n")
    end = next((k for k, x in enumerate(lines) if re.match(r"\s+\S+.*\|", x) or re.match(r"\s*\d+ files? changed", x)), len(lines))
    message = lines[:end]
    return {
        "hash": fields.get("commit", "").split()[0] if fields.get("commit") else "",
        "author": who.group(1) if who else fields.get("Author:", "").strip(),
        "author_email": who.group(2) if who else "",
        "date": date,
        "subject": message[0].strip() if message else "",
        "body": "\n".join(message[1:]).strip(),
        "files": [m.group(1) for x in lines[end:] if (m := _STAT.match(x))],
    }


def commits(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row for each text, with patch tag, subsystems, archive link and a date window of the discussion."""

    @F.pandas_udf(KIND)
    def parse(series):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = pd.DataFrame([parse_show(x or "") for x in series], columns=["hash", "author", "author_email", "date", "subject", "body", "files"])
        rows["date"] = pd.to_datetime(rows["date"])
        return rows

    rows = texts.select(parse(column).alias("c")).select("c.*")
    tag = M.patch_tag(F.col("subject"))
    return rows.withColumns(
        {
            "patch_index": tag["number"],
            "patch_total": tag["total"],
            "patch_version": tag["version"],
            "is_cover_letter": tag["cover"],
            "subsystems": M.subsystems(F.col("files")),
            "lore_url": M.archive_link(F.col("body")),
            "date_from": F.date_format(F.date_sub(F.to_date("date"), 60), "yyyy-MM-dd"),
            "date_to": F.date_format(F.date_add(F.to_date("date"), 14), "yyyy-MM-dd"),
            "search_terms": search_terms(F.col("subject"), F.col("body"), F.col("files")),
        }
    )


def search_terms(subject: Column, body: Column, files: Column) -> Column:
    """At most five terms: the clean subject, its area, the two commonest function names, two file names."""
    clean = F.trim(F.regexp_replace(subject, r"^\[PATCH[^\]]*\]\s*", ""))
    area = F.regexp_extract(clean, r"^([\w/]+):\s", 1)
    found = F.regexp_extract_all(F.concat(subject, F.lit("\n"), body), F.lit(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+){2,})\b"), F.lit(1))
    # the commonest first, ties by first place
    ranked = F.array_sort(F.transform(F.array_distinct(found), lambda f: F.struct((-F.size(F.filter(found, lambda x: x == f))).alias("n"), F.array_position(found, f).alias("at"), f.alias("f"))))
    names = F.filter(F.transform(F.slice(files, 1, 2), lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.\w+$", "")), lambda n: F.length(n) > 3)
    every = F.concat(F.array(clean, area), F.transform(F.slice(ranked, 1, 2), lambda r: r["f"]), names)
    return F.slice(F.array_distinct(F.filter(every, lambda t: t != "")), 1, 5)


def related(rows: DataFrame, days: int = 7, limit: int = 10) -> DataFrame:
    """(hash, related): commits of the same author at most so many days apart that share a file.

    An equi-join on author, file and day bucket, then the exact window; a hot author is split by file and time.
    """
    bucket = F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / (86400 * days)).cast("bigint")
    a = rows.select("hash", "author", "date", F.explode("files").alias("file"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = rows.select(F.col("hash").alias("related"), "author", F.col("date").alias("at"), F.explode("files").alias("file"), bucket.alias("bucket"))
    reach = F.expr(f"interval {days} days")
    near = a.join(b, ["author", "file", "bucket"]).where(F.col("at").between(F.col("date") - reach, F.col("date") + reach) & (F.substring("related", 1, 8) != F.substring("hash", 1, 8)))
    pairs = near.select("hash", "related", "at").distinct()
    place = F.row_number().over(W.partitionBy("hash").orderBy(F.desc("at"), "related"))
    return pairs.withColumn("place", place).where(F.col("place") <= limit).select("hash", "related")


def commit_summary(df: DataFrame) -> DataFrame:
    """df with summary: what a reader needs of a commit in one text."""
    lines = F.array_compact(F.array(F.concat(F.lit("Commit: "), "hash"), F.concat(F.lit("Subject: "), "subject"), F.concat(F.lit("Author: "), "author"), F.concat(F.lit("Files: "), F.concat_ws(", ", F.slice("files", 1, 5))), F.when(F.trim("body") != "", F.concat(F.lit("\n--- Commit Message ---\n"), F.substring(F.trim("body"), 1, 600)))))
    return df.withColumn("summary", F.concat_ws("\n", lines))

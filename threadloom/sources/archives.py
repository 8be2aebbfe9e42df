"""Mail archives on disk: mbox (plain or gzip), single raw mails and JSON mails, as rows of mails.

Files are split over tasks by Spark's binary file reader or by the `mbox` data source; MIME has no parser in the JVM, so
each file is parsed in Python. Modes: `search` joins all text parts and drops mails with neither subject nor sender;
`thread` takes the first text part, keeps mails with subject or body, and gives nothing for an HTML error page.
"""

from __future__ import annotations

import email
import email.policy
import gzip
import re
from collections.abc import Iterator
from email.header import decode_header
from email.message import Message

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from threadloom.tables import cut

SCHEMA = "subject string, `from` string, `to` string, cc string, date string, body string, attachments array<string>, message_id string, in_reply_to string, `references` array<string>, source_url string, path string, input_pos bigint"
# How the From lines of an archive look, and the marks of an error page.
FROM_STRICT = re.compile(r"(?m)^From \S+ \w{3} \w{3} +\d+ \d+:\d+:\d+ \d{4}$")
FROM_LOOSE = re.compile(r"(?m)^From \S+.*\d{4}\s*$")
ERROR_MARKS = ("<!doctype html", "<html", "<head>", "<body")
CHARSETS = ("utf-8", "latin-1")


def decode_bytes(data: bytes, charset: str | None) -> str:
    """The declared character set, then UTF-8, then Latin-1; what can't be read is replaced."""
    for name in (charset, *CHARSETS):
        try:
            return data.decode(name or "utf-8")
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def header(value: object, joiner: str = "") -> str:
    """An encoded header as text; its parts are joined by `joiner`."""
    if value is None:
        return ""
    parts = [decode_bytes(x, c) if isinstance(x, bytes) else x for x, c in decode_header(str(value))]
    return joiner.join(parts).strip()


def text_of(message: Message, mode: str) -> str:
    parts = [p for p in message.walk() if p.get_content_type() == "text/plain" and "attachment" not in str(p.get("Content-Disposition", ""))] if message.is_multipart() else [message]
    texts = [decode_bytes(p.get_payload(decode=True) or b"", p.get_content_charset()) for p in parts]
    return (texts[0] if texts else "") if mode == "thread" else "".join(texts)


def mail(message: Message, mode: str) -> dict | None:
    """One mail as a row, or None where the mode drops it."""
    joiner = " " if mode == "thread" else ""
    subject, sender = header(message.get("Subject"), joiner), header(message.get("From"), joiner)
    body = text_of(message, mode)
    if not (subject or body) if mode == "thread" else not (subject or sender):
        return None
    key, reply = str(message.get("Message-ID", "")).strip(), str(message.get("In-Reply-To", "")).strip()
    refs = [r for r in re.split(r"\s+" if mode == "thread" else r"[\s,]+", str(message.get("References", "")).strip()) if r]
    if mode == "thread":
        wrap = lambda x: f"<{x.strip('<>')}>" if x.strip("<> ") else ""
        key, reply, refs = wrap(key), wrap(reply), [wrap(r) for r in refs]
    names = [n for p in message.walk() if (n := p.get_filename())] if message.is_multipart() else []
    url = f"/all/{key.strip('<>')}/" if key else ""
    both = {} if mode == "thread" else {"to": header(message.get("To")), "cc": header(message.get("Cc"))}
    return {"subject": subject, "from": sender, "to": None, "cc": None, "date": str(message.get("Date", "")), "body": body, "attachments": names, "message_id": key, "in_reply_to": reply, "references": refs, "source_url": url} | both


def mails(content: bytes, mode: str = "search") -> Iterator[dict]:
    """The mails of one file in their order."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    if mode == "thread" and any(m in content[:500].decode("latin-1").lower() for m in ERROR_MARKS):
        return
    text = decode_bytes(content, None)
    split = (FROM_LOOSE if mode == "thread" else FROM_STRICT).split(text)
    for block in split:
        if block.strip():
            message = email.message_from_bytes(block.strip().encode("utf-8", "surrogateescape"), policy=email.policy.compat32) if not block.isascii() else email.message_from_string(block.strip(), policy=email.policy.compat32)
            if row := mail(message, mode):
                yield row


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "search")

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.path.removeprefix("file://")
        found = sorted(p for x in glob.glob(path) for p in ([x] if os.path.isfile(x) else (os.path.join(d, f) for d, _, fs in os.walk(x) for f in fs)))
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for k, m in enumerate(mails(f.read(), self.mode)):
                yield (*m.values(), partition.path, k)


class MboxDataSource(DataSource):
    """spark.read.format("mbox").option("mode", "thread").load(path): one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_mbox(spark: SparkSession, path: str, mode: str = "search") -> DataFrame:
    """Mails of archives in any file system that Spark reads; splits over files, keeps path and place in the file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [m | {"path": p, "input_pos": k} for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, m in enumerate(mails(c, mode))]
            text = pa.string()
            fields = [(n, pa.list_(text) if n in ("attachments", "references") else pa.int64() if n == "input_pos" else text) for n in ("subject", "from", "to", "cc", "date", "body", "attachments", "message_id", "in_reply_to", "references", "source_url", "path", "input_pos")]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return files.mapInArrow(run, SCHEMA)


def read_json_mails(spark: SparkSession, path: str) -> DataFrame:
    """Mails saved as JSON, one object or a list in a file."""
    kinds = "subject string, `from` string, sender string, `to` string, cc string, date string, body string, message_id string, in_reply_to string, `references` array<string>, source_url string"
    rows = spark.read.schema(kinds).json(path, multiLine=True)
    return rows.withColumns({"from": F.coalesce("from", "sender"), "path": F.col("_metadata.file_path")}).drop("sender")


def write_json_mails(df: DataFrame, path: str, key: str = "message_id") -> int:
    """One JSON file set for each topic, written once: rows whose topic holds their id already are left out, and of rows
    of one topic and id in df one is written. Gives how many were new. Rows without an id are told apart by all their
    columns. A second run adds nothing."""
    spark = df.sparkSession
    mark = F.coalesce(F.nullif(F.col(key), F.lit("")), F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != "topic"])), 256))
    fresh = df.withColumn("_mark", mark).withColumn("topic", F.coalesce("topic", F.lit("")))
    first = fresh.groupBy("topic", "_mark").agg(F.min(F.struct(*[F.to_json(F.struct(*df.columns)).alias("_order"), F.struct(*df.columns).alias("row")])).alias("m")).select("topic", "_mark", "m.row")
    try:
        held = spark.read.schema(df.schema).option("basePath", path).json(path).withColumn("topic", F.col("topic").cast("string"))
        held = held.withColumn("_mark", mark).select(F.coalesce("topic", F.lit("")).alias("topic"), "_mark").distinct()
        first = first.join(held, ["topic", "_mark"], "left_anti")
    except AnalysisException:  # nothing is there yet
        pass
    new = cut(first.select("row.*"))
    count = new.count()
    if count:
        new.write.mode("append").partitionBy("topic").json(path)
    return count


def read_mail_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, mails): how many mails each JSON file below a folder holds; 0 if it is no list."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    listed = F.when(F.trim("value").startswith("["), F.coalesce(F.json_array_length("value"), F.lit(0))).otherwise(0)
    return files.select("path", listed.cast("bigint").alias("mails"))


# The fields of a topic file.
TOPIC_TEXTS = ["description", "ai_filter_prompt", "ai_summary_extra"]
TOPIC_LISTS = ["search_keywords", "filter_keywords", "filter_require_subsystem", "filter_require_topic", "subject_blacklist"]


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """One row for each topic file (JSON): name (else the file's), display_name (else the name), texts ('' where missing) and
    lists (empty where missing)."""
    kinds = ", ".join([f"{c} string" for c in ("name", "display_name", *TOPIC_TEXTS)] + [f"{c} array<string>" for c in TOPIC_LISTS])
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.from_json("value", kinds).alias("j"))
    name = F.coalesce("j.name", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    texts = [F.coalesce(f"j.{c}", F.lit("")).alias(c) for c in TOPIC_TEXTS]
    lists = [F.coalesce(F.col(f"j.{c}"), F.array().cast("array<string>")).alias(c) for c in TOPIC_LISTS]
    return files.select(name.alias("name"), F.coalesce(F.col("j.display_name"), name).alias("display_name"), *texts, *lists)


def newest(df: DataFrame, at: str, limit: int) -> DataFrame:
    """The latest rows, as a search with a limit gives them."""
    return df.orderBy(F.desc_nulls_last(at)).limit(limit)

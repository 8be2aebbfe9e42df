"""Reports and exports: Markdown reports, bilingual pages, the dashboard, thread texts for summaries.

Rows are aggregated and ordered in Spark; a document is one string a thread, so rendering is distributed, and only
the finished index page is put together on the driver.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import backends, bodies
from threadloom.functions import mailtext as M


def thread_texts(mails: DataFrame, limit: int = 15, size: int = 1000) -> DataFrame:
    """(thread_id, text): the first mails of each thread, each cut, with a note of how many were left out."""
    # places are given to slim rows, and only those within the limit are shuffled and joined to their bodies
    filed = mails.where("thread_id <> ''")
    place = F.row_number().over(W.partitionBy("thread_id").orderBy("date", "id"))
    first = filed.select("thread_id", "id", "date", place.alias("place")).where(F.col("place") <= limit).drop("date")
    total = filed.groupBy("thread_id").agg(F.count("*").alias("total"))
    rows = first.join(filed.select("id", "date", "subject", "from_name", "body"), "id").join(total, "thread_id")
    part = F.concat(F.lit("--- "), F.coalesce("from_name", F.lit("")), F.lit(" | "), F.coalesce("date", F.lit("")), F.lit("\n"), F.substring(F.coalesce("body", F.lit("")), 1, size))
    grouped = rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("text")))).alias("parts"), F.first("total").alias("total"))
    note = F.when(F.col("total") > limit, F.array(F.concat(F.lit("... "), (F.col("total") - limit).cast("string"), F.lit(" more mails")))).otherwise(F.array().cast("array<string>"))
    return grouped.select("thread_id", F.array_join(F.concat(F.transform("parts", lambda p: p["text"]), note), "\n\n").alias("text"))


def answer_fields(answer: F.Column, fallback: int = 500) -> F.Column:
    """The JSON fields of a summary answer, with or without a code fence; unreadable text becomes the summary."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```\w*\s*", ""), r"\s*```$", "")
    parsed = F.from_json(bare, "summary string, key_points array<string>, consensus string, design_decisions array<string>, related_files array<string>, related_functions array<string>, tags array<string>")
    return F.when(parsed["summary"].isNotNull(), parsed).otherwise(F.named_struct(F.lit("summary"), F.substring(answer, 1, fallback), *[x for c, t in (("key_points", "array<string>"), ("consensus", "string"), ("design_decisions", "array<string>"), ("related_files", "array<string>"), ("related_functions", "array<string>"), ("tags", "array<string>")) for x in (F.lit(c), F.lit(None).cast(t))]))


def summarise(texts: DataFrame, backend: backends.TextBackend) -> DataFrame:
    """(thread_id, summary) by a back-end, in Arrow batches."""
    return texts.select("thread_id", bodies.apply(backend.summarise, "string", F.col("text")).alias("summary"))


def digest(threads: DataFrame, size: int = 50) -> DataFrame:
    """(batch, text): numbered summaries of processed threads, so many in a text."""
    from threadloom.operators.knowledge import numbered

    rows = numbered(threads.where("processed = 1"), "id").withColumn("batch", F.expr(f"(n - 1) div {size}"))
    line = F.concat(((F.col("n") - 1) % size + 1).cast("string"), F.lit(". "), F.coalesce("subject", F.lit("")), F.lit("\n   "), F.coalesce("summary_zh", F.lit("")))
    return rows.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


#: Mails in one part of a thread's report or page, so that no row holds a thread of any size.
PART = 500


def placed(built: DataFrame) -> DataFrame:
    """(root, id, mid, subject, place): the place of each mail in its thread, root first, then by depth and date.

    All mails are numbered in one order by range partitions, so a thread of any size is spread over tasks.
    """
    from threadloom.operators.knowledge import numbered

    slim = numbered(built.select("root", "id", "mid", "subject", "depth", "sent_at"), "root", "depth", F.asc_nulls_first("sent_at"), "id")
    start = slim.groupBy("root").agg(F.min("n").alias("start"), F.count("*").alias("total"))
    return slim.join(start, "root").select("root", "id", "mid", "subject", (F.col("n") - F.col("start") + 1).alias("place"), "total")


def markdown(built: DataFrame, mails: DataFrame, topic: str, replies: bool = True, size: int = 2000) -> DataFrame:
    """(root, part, text): Markdown of each thread, root first, in parts; without replies only their number is given."""
    rows = placed(built)
    rows = (rows if replies else rows.where("place = 1")).join(mails.select("id", "body", "from_name", "date"), "id")
    text = F.coalesce("body", F.lit(""))
    shown = F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("\n\n*(cut)*"))).otherwise(text)
    block = F.concat(F.when(F.col("place") == 1, "## ").otherwise("### "), F.coalesce("subject", F.lit("")), F.lit("\n\n**"), F.coalesce("from_name", F.lit("")), F.lit("** "), F.coalesce("date", F.lit("")), F.lit("\n\n"), shown)
    grouped = rows.groupBy("root", F.expr(f"(place - 1) div {PART}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))).alias("blocks"), F.first("total").alias("total"))
    head = F.concat(F.lit(f"# {topic}\n\n"), F.lit("Replies: "), (F.col("total") - 1).cast("string"))
    return grouped.select("root", "part", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n")).alias("text"))


def code_report(mails: DataFrame, known: DataFrame | None = None, most: int = 30) -> DataFrame:
    """(kind, name, local): files and functions that mails refer to; local tells whether a file is in a listing."""
    files = mails.select(F.explode(M.code_files(F.col("body"))).alias("name")).distinct().withColumn("kind", F.lit("file"))
    functions = mails.select(F.explode(M.code_functions(F.col("body"))).alias("name")).groupBy("name").count().orderBy(F.desc("count"), "name").limit(most).select("name", F.lit("function").alias("kind"))
    out = files.unionByName(functions)
    if known is None:
        return out.select("kind", "name", F.lit(False).alias("local"))
    listed = known.select(F.col("path").alias("name"), F.lit(True).alias("local")).distinct()
    return out.join(listed, "name", "left").select("kind", "name", F.coalesce("local", F.lit(False)).alias("local"))


def bilingual_pages(built: DataFrame, mails: DataFrame, backend: backends.TextBackend) -> DataFrame:
    """(root, part, html): the pages of each thread, each mail once, paragraphs beside their translations, diffs apart.

    Mails are rendered by row in Arrow batches; a page is the ordered concatenation of at most PART of them.
    """
    render = bodies.apply(lambda s, f, d, b, key: _mail_html(backend, s, f, d, b, key), "string", F.col("subject"), F.col("from_name"), F.col("date"), F.col("body"), F.col("mid"))
    rows = placed(built).join(mails.select("id", "body", "from_name", "date"), "id").select("root", "place", render.alias("node"))
    pages = rows.groupBy("root", F.expr(f"(place - 1) div {PART}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("nodes"))
    return pages.select("root", "part", F.concat(F.lit('<div class="thread">'), F.array_join(F.transform("nodes", lambda n: n["node"]), "\n"), F.lit("</div>")).alias("html"))


def _mail_html(backend: backends.TextBackend, subject: str, sender: str, date: str, body: str, key: str) -> str:
    text, diff = bodies.split_diff(body)
    pairs = bodies.keep_text(backends.translate_aligned(backend, body), text) if text else []
    cells = [f'<div class="row"><div class="en">{html.escape(a)}</div>' + (f'<div class="cn">{html.escape(b)}</div>' if b is not None else "") + "</div>" for a, b in pairs] or [f'<div class="row"><div class="en">{html.escape(text)}</div></div>']
    code = "\n".join(f'<span class="diff-comment-cn">{html.escape(x[4:])}</span>' if x.startswith("\0CN\0") else html.escape(x) for x in backends.translate_comments(backend, diff).split("\n")) if diff else ""
    part = f'<pre class="diff">{code}</pre>' if code else ""
    return f'<div class="email-node" id="{html.escape(key)}" data-author="{html.escape(sender)}"><h3>{html.escape(subject)}</h3><p>{html.escape(sender)} {html.escape(date)}</p>{"".join(cells)}{part}</div>'


def artifacts(files: DataFrame, contents: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each commit or single file from a listing (stem, ext, relpath, size_kb, mtime), latest first.

    Files whose stem begins with a hash of 8 to 12 hex digits go together; status: translated, packed, raw or other.
    """
    prefix = F.regexp_extract("stem", "^([0-9a-f]{8,12})", 1)
    kind = F.when((F.col("ext") == ".html") & F.contains("stem", F.lit("translated")), "translated").when(F.col("ext") == ".html", "other").when(F.col("ext") == ".txt", "packed").when(F.col("ext") == ".json", "raw").otherwise("other")
    rank = F.when(kind == "translated", 4).when(kind == "packed", 3).when(kind == "raw", 2).otherwise(1)
    rows = files.select(F.when(prefix != "", prefix).otherwise(F.col("stem")).alias("id"), prefix.alias("commit_hash"), kind.alias("status"), rank.alias("rank"), "relpath", "size_kb", "mtime")
    best = rows.groupBy("id").agg(F.max_by(F.struct("commit_hash", "status", F.col("relpath").alias("primary_path"), F.col("size_kb").alias("primary_size_kb"), "mtime"), F.struct("rank", "mtime", "relpath")).alias("b"), F.count("*").alias("files"))
    out = best.select("id", "b.*", "files")
    return (contents(out) if contents else out).orderBy(F.desc("mtime"), "id")


def listing(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(stem, ext, path, relpath, size_kb, mtime) of the files below a folder; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"), "path", name.alias("relpath"), F.expr("length div 1024").alias("size_kb"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("mtime")).where("relpath <> 'dashboard.html'")


def dashboard(reports: DataFrame, most: int = 100_000) -> str:
    """An index page with the reports as JSON. The rows are one for each commit that was reported on; a page of more than
    `most` rows can't be used, so more are an error."""
    rows: pd.DataFrame = reports.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} reports: filter them before they go into one page")
    return f'<!doctype html><html><head><title>Reports</title></head><body><script id="data" type="application/json">{rows.to_json(orient="records", force_ascii=False).replace("</", "<\\/")}</script></body></html>'


def knowledge_pages(threads: DataFrame, reports: DataFrame, size: int = PART) -> DataFrame:
    """(kind, page, html): the export of the knowledge base: cards of visible threads and of reports, latest first, so many
    on a page. Cards are rendered in the JVM and pages put together by rows of one page, so that no task holds them all."""
    from threadloom.operators.knowledge import numbered

    esc = lambda c: M.escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")), quotes=True)
    tags = F.array_join(F.transform(M.json_list(F.col("tags")), lambda x: F.concat(F.lit('<span class="tag">'), M.escape_html(x, quotes=True), F.lit("</span>"))), "")
    card = F.concat(F.lit('<div class="card" data-tags="'), esc("tags"), F.lit('"><h3>'), esc("subject"), F.lit("</h3><p>"), esc("start_date"), F.lit(" - "), esc("end_date"), F.lit(" | "), esc("email_count"), F.lit("</p><p>"), esc("summary_zh"), F.lit("</p>"), tags, F.lit("</div>"))
    cards = threads.where("hidden = 0").select(F.lit("threads").alias("kind"), F.coalesce("end_date", F.lit("")).alias("at"), "id", card.alias("html"))
    page = F.concat(F.lit('<div class="report"><h3>'), esc("topic"), F.lit("</h3><pre>"), esc("content"), F.lit("</pre></div>"))
    told = reports.select(F.lit("reports").alias("kind"), F.lpad(F.coalesce(F.col("created_at").cast("bigint"), F.lit(0)).cast("string"), 20, "0").alias("at"), F.col("id").cast("string").alias("id"), page.alias("html"))
    rows = numbered(cards.unionByName(told), "kind", F.desc("at"), "id")
    start = rows.groupBy("kind").agg(F.min("n").alias("start"))
    rows = rows.join(F.broadcast(start), "kind").withColumn("page", F.expr(f"(n - start) div {size}"))
    whole = rows.groupBy("kind", "page").agg(F.array_sort(F.collect_list(F.struct("n", "html"))).alias("cards"))
    return whole.select("kind", "page", F.concat(F.lit("<!doctype html><html><body>"), F.array_join(F.transform("cards", lambda x: x["html"]), "\n"), F.lit("</body></html>")).alias("html"))

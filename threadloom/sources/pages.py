"""Mail in web pages and feeds: Atom feeds, mail pages, day indexes; title and counts of produced pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the id of a page's mail is made of its address's hash; the entities of pages.
PAGE_ID = ("<lkml-", "@lkml.org>")
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _tag(xml: Column, name: str) -> Column:
    return unescape(F.trim(F.regexp_extract(xml, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)))


def atom_entries(feeds: DataFrame, column: str = "value") -> DataFrame:
    """One row for each entry of Atom feeds. The id comes from the link; a feed has no reply links."""
    entries = feeds.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    e = F.col("e")
    link = F.regexp_extract(e, r'<link\s+href="([^"]+)"', 1)
    key = F.regexp_extract(link, "/all/([^/]+)/", 1)
    who, address = _tag(e, "name"), _tag(e, "email")
    return entries.select(
        _tag(e, "title").alias("subject"),
        F.when(address != "", F.concat(who, F.lit(" <"), address, F.lit(">"))).otherwise(who).alias("from"),
        _tag(e, "updated").alias("date"),
        unescape(F.regexp_extract(e, r"(?s)<pre[^>]*>(.*?)</pre>", 1)).alias("body"),
        F.when(key != "", F.concat(F.lit("<"), key, F.lit(">"))).otherwise("").alias("message_id"),
        F.lit("").alias("in_reply_to"),
        link.alias("source_url"),
    )


class _Page(HTMLParser):
    """The text of <pre> and the values beside the labels Date, Subject and From."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.label, self.body = 0, "", []
        self.fields = {"date": "", "subject": "", "from": ""}

    def handle_starttag(self, tag: str, attrs: list) -> None:  # noqa: ARG002
        if tag == "pre":
            self.depth += 1
        elif tag == "br" and self.depth:
            self.body.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "pre" and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.body.append(data)
        elif text := data.strip():
            name = text.rstrip(":").lower()
            if name in self.fields:
                self.label = name
            elif self.label:
                self.fields[self.label], self.label = self.fields[self.label] or text, ""


def page_fields(html: str) -> dict:
    page = _Page()
    page.feed(html)
    return page.fields | {"body": "".join(page.body).strip()}


def mail_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One mail for each page. The id is made from the address; a page without date takes it from the address."""

    @F.pandas_udf("date string, subject string, `from` string, body string")
    def parse(series):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([page_fields(x or "") for x in series], columns=["date", "subject", "from", "body"])

    day = F.regexp_replace(F.regexp_extract(url, r"/(\d{4}/\d{1,2}/\d{1,2})/", 1), "/", "-")
    rows = pages.select(url, parse(html).alias("p"))
    key = F.concat(F.lit(PAGE_ID[0]), F.md5(url), F.lit(PAGE_ID[1]))
    return rows.select(F.coalesce(F.nullif("p.date", F.lit("")), day).alias("date"), "p.subject", F.col("p.from").alias("from"), "p.body", key.alias("message_id"), F.lit("").alias("in_reply_to"), F.col(url).alias("source_url"))


def day_index(pages: DataFrame, html: str = "html", base: str = "") -> DataFrame:
    """(pos, url, subject) of the mails that a day's index links."""
    pattern = r'<a[^>]+href="(/[a-z]+/\d{4}/\d{1,2}/\d{1,2}/\d+)"[^>]*>([^<]*)</a>'
    found = pages.select(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("u"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("s"))
    return found.select(F.posexplode(F.arrays_zip("u", "s")).alias("pos", "x")).select("pos", F.concat(F.lit(base), F.col("x.u")).alias("url"), unescape(F.trim("x.s")).alias("subject"))


def page_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, source hash, numbers of mails and threads, and the authors of produced pages."""
    h = F.col(html)
    authors = F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit('data-author="([^"]+)"'), F.lit(1))))
    return pages.withColumns(
        {
            "subject": F.trim(F.regexp_extract(F.substring(h, 1, 8192), "<title>(.*?)</title>", 1)),
            "source_hash": F.regexp_extract(F.substring(h, 1, 8192), 'content="([a-f0-9]+)"', 1),
            "email_count": F.regexp_count(h, F.lit('class="email-node"')).cast("bigint"),
            "thread_count": F.regexp_count(h, F.lit('class="thread-title"')).cast("bigint"),
            "authors": authors,
            "participant_count": F.size(authors).cast("bigint"),
        }
    ).drop(html)

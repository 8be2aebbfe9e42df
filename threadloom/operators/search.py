"""Full-text search over an inverted index, with the query language of the store's index.

The index has one row for each token of a document: (doc, col, pos, token); tokens are runs of letters and digits in lower
case without diacritics. A query is parsed on the driver into a tree; each leaf becomes a filter of the index (pushed
to its scan), and the tree becomes joins of document ids.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEXED = 2000
COLUMNS = ("subject", "body", "summary")


class QueryError(ValueError):
    """A search expression that the language doesn't allow."""


def _marks() -> tuple[str, str]:
    """Letters with diacritics and what they fold to, from the Unicode decompositions of the Latin and Greek blocks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD = _marks()


def folded(text: Column) -> Column:
    """Lower case without diacritics, also without combining marks."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Mn}+", ""), *FOLD)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def index(emails: DataFrame, key: str = "id") -> DataFrame:
    """(doc, col, pos, token) of subject and the first 2000 characters of the body, which is all that the store indexes."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.substring(c, 1, INDEXED) if c == "body" else F.col(c)).alias("words")) for c in COLUMNS if c in emails.columns])
    by_column = emails.select(F.col(key).alias("doc"), F.explode(parts).alias("p"))
    return by_column.select("doc", "p.col", F.posexplode("p.words").alias("pos", "token"))


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    col: str | None = None


@dataclass
class Near:
    phrases: list[Phrase]
    within: int = 10


@dataclass
class Both:
    op: str
    left: object
    right: object


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*"\*?)|(NEAR\s*\()|([():,])|([\w\x80-\U0010ffff]+\*?)|(\S))')


def parse(query: str) -> object:
    """The tree of a query: words (all must occur), "phrases", prefix*, col:word, NEAR(a b, n), AND, OR, NOT, brackets."""
    items, at = [], 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        at = m.end()
        if m.group(5):
            raise QueryError(f"syntax error near {m.group(5)!r}")
        items.append(m.group(m.lastindex).strip())
    pos = 0

    def peek() -> str | None:
        return items[pos] if pos < len(items) else None

    def take(want: str | None = None) -> str:
        nonlocal pos
        if pos >= len(items) or (want and items[pos] != want):
            raise QueryError("unexpected end" if pos >= len(items) else f"syntax error near {items[pos]!r}")
        pos += 1
        return items[pos - 1]

    def phrase(text: str, col: str | None = None) -> Phrase:
        prefix = text.endswith("*")
        words = re.findall(r"[^\W_]+", fold(text.rstrip("*").strip('"')))
        if not words:
            raise QueryError("empty phrase")
        return Phrase(words, prefix, col)

    def atom() -> object:
        t = take()
        if t == "(":
            inner = any_of()
            take(")")
            return inner
        if t.startswith("NEAR") and t.endswith("("):
            phrases, within = [], 10
            while peek() not in (")", ",", None):
                phrases.append(phrase(take()))
            if peek() == ",":
                take()
                within = int(take())
            take(")")
            return Near(phrases, within)
        if t in (")", ":", ",", "AND", "OR", "NOT"):
            raise QueryError(f"syntax error near {t!r}")
        if peek() == ":":
            if t not in COLUMNS:
                raise QueryError(f"no such column: {t}")
            take()
            return phrase(take(), t)
        return phrase(t)

    def without() -> object:
        left = atom()
        while peek() not in (None, ")", "AND", "OR", "NOT"):
            left = Both("AND", left, atom())
        while peek() == "NOT":
            take()
            left = Both("NOT", left, atom())
        return left

    def all_of() -> object:
        left = without()
        while peek() == "AND":
            take()
            left = Both("AND", left, without())
        return left

    def any_of() -> object:
        left = all_of()
        while peek() == "OR":
            take()
            left = Both("OR", left, all_of())
        return left

    if not items:
        raise QueryError("empty query")
    tree = any_of()
    if pos < len(items):
        raise QueryError(f"syntax error near {items[pos]!r}")
    return tree


def _starts(idx: DataFrame, p: Phrase) -> DataFrame:
    """(doc, col, pos, end) where a phrase begins and ends; the words of a phrase are adjacent in one column."""
    where = idx.where(F.col("col") == p.col) if p.col else idx
    out = None
    for k, word in enumerate(p.words):
        last = k == len(p.words) - 1
        hit = where.where(F.col("token").startswith(word) if p.prefix and last else F.col("token") == word).select("doc", "col", (F.col("pos") - k).alias("pos"))
        out = hit if out is None else out.join(hit, ["doc", "col", "pos"])
    return out.distinct().withColumn("end", F.col("pos") + len(p.words) - 1)


def matches(idx: DataFrame, query: str | object) -> DataFrame:
    """(doc): the documents that a query finds, each once and without ranking."""
    tree = parse(query) if isinstance(query, str) else query
    if isinstance(tree, Phrase):
        return _starts(idx, tree).select("doc").distinct()
    if isinstance(tree, Near):
        first, *rest = [_starts(idx, p) for p in tree.phrases]
        out = first.select("doc", "col", "pos", "end")
        for k, other in enumerate(rest):
            b = other.select("doc", "col", F.col("pos").alias(f"p{k}"), F.col("end").alias(f"e{k}"))
            out = out.join(b, ["doc", "col"]).where(((F.col(f"p{k}") > F.col("end")) & (F.col(f"p{k}") - F.col("end") - 1 <= tree.within)) | ((F.col("pos") > F.col(f"e{k}")) & (F.col("pos") - F.col(f"e{k}") - 1 <= tree.within)))
            out = out.withColumns({"pos": F.least("pos", f"p{k}"), "end": F.greatest("end", f"e{k}")}).select("doc", "col", "pos", "end")
        return out.select("doc").distinct()
    left, right = matches(idx, tree.left), matches(idx, tree.right)
    if tree.op == "OR":
        return left.unionByName(right).distinct()
    return left.join(right, "doc", "left_semi" if tree.op == "AND" else "left_anti")


def search(emails: DataFrame, query: str, idx: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The mails that a query finds, in the order they were stored. Errors in the query are raised."""
    found = matches(index(emails) if idx is None else idx, query).withColumnRenamed("doc", "id")
    out = emails.join(found, "id", "left_semi")
    return out.orderBy("id").limit(limit) if limit else out


def search_or_like(emails: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The web search: full text, and a substring search where that fails or finds nothing."""
    try:
        found = search(emails, query, limit=limit)
        if not found.isEmpty():
            return found
    except QueryError:
        pass
    pattern = f"%{query}%"
    return emails.where(F.col("subject").ilike(pattern) | F.col("body").ilike(pattern)).orderBy(F.desc_nulls_last("date"), "id").limit(limit)

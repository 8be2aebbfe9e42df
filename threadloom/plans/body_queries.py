"""Queries of body texts, reports and context documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import backends, bodies
from threadloom.functions import mailtext as M
from threadloom.operators import reports, threads
from threadloom.plans.registry import Registry, Tables
from threadloom.sources import contexts

registry = Registry()
add = registry.add
c = F.col


@add("preprocessed_bodies")
def preprocessed_bodies(t: Tables) -> DataFrame:
    rows = t.emails.where("body is not null").select("id", "body", M.priority_of(c("from_email"), c("subject"), c("body")).alias("priority")).where("priority > 0")
    return rows.select("id", "priority", bodies.apply(lambda p, b: bodies.preprocess(int(p), b), "string", c("priority"), c("body")).alias("text"))


@add("body_diff_parts")
def body_diff_parts(t: Tables) -> DataFrame:
    size = bodies.apply(lambda b: len(bodies.split_diff(b)[1]), "bigint", c("body"))
    return t.emails.where("body is not null").select("id", size.alias("diff_chars"), bodies.apply(bodies.should_translate, "boolean", c("body")).alias("translate"))


@add("code_line_shares")
def code_line_shares(t: Tables) -> DataFrame:
    count = bodies.apply(lambda b: sum(map(bodies.is_code_line, b.split("\n"))), "bigint", c("body"))
    return t.emails.where("body is not null").select("id", F.size(F.split("body", "\n")).cast("bigint").alias("lines"), count.alias("code_lines"))


@add("merged_paragraphs")
def merged_paragraphs(t: Tables) -> DataFrame:
    return t.paragraphs.where("text_orig is not null").select("paragraph_id", bodies.apply(bodies.merge_soft_breaks, "string", c("text_orig")).alias("text"))


@add("body_chunks")
def body_chunks(t: Tables) -> DataFrame:
    parts = bodies.apply(lambda b: bodies.chunks(b, 1200), "array<string>", c("body"))
    return t.emails.where("body is not null").select("id", F.posexplode(parts).alias("pos", "chunk"))


@add("wrapped_bodies")
def wrapped_bodies(t: Tables) -> DataFrame:
    return t.emails.where("body is not null").select("id", bodies.apply(bodies.wrap, "string", c("body")).alias("text"))


@add("untranslatable_paragraphs")
def untranslatable_paragraphs(t: Tables) -> DataFrame:
    return t.paragraphs.where("text_orig is not null").select("paragraph_id", bodies.apply(bodies.untranslatable, "boolean", c("text_orig")).alias("fixed"))


@add("aligned_translations")
def aligned_translations(t: Tables) -> DataFrame:
    """Paragraphs of each mail against their cached translations, aligned as if only the texts were known."""
    from threadloom.operators import knowledge as K

    found = K.cache_lookup(t.paragraphs.withColumn("backend", F.lit("api_alpha")), t.translation_cache, "text_orig").where("text_orig is not null")
    item = F.struct("para_no", "paragraph_id", "text_orig", "translated")
    rows = found.groupBy("email_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    originals, translated = F.transform("p", lambda x: x["text_orig"]), F.filter(F.transform("p", lambda x: x["translated"]), lambda x: x.isNotNull())
    pairs = bodies.apply(lambda a, b: [-1 if k is None else int(k) for k in bodies.align(list(b), list(a), [bodies.untranslatable(x) for x in a])], "array<int>", originals, translated)
    return rows.select("email_id", F.size("p").alias("paragraphs"), pairs.alias("pairs"))


@add("translated_mails")
def translated_mails(t: Tables) -> DataFrame:
    backend = backends.Dictionary({})
    pairs = bodies.apply(lambda b: [{"en": a, "cn": x} for a, x in backends.translate_aligned(backend, b)], "array<struct<en:string,cn:string>>", c("body"))
    return t.emails.where("body is not null").select("id", F.posexplode(pairs).alias("pos", "p")).select("id", "pos", "p.en", "p.cn")


@add("relevant_mails")
def relevant_mails(t: Tables) -> DataFrame:
    backend = backends.Dictionary({}, words=["latency"])
    rows = t.emails.where(M.wanted(c("subject"), c("body"), ["lanes", "meter"]))
    judged = rows.select("id", bodies.apply(lambda s, f, b: backend.judge(s, f, b[:800])[0], "double", c("subject"), c("from_email"), c("body")).alias("score"))
    return judged.where("score > 0")


@add("thread_texts")
def thread_texts(t: Tables) -> DataFrame:
    return reports.thread_texts(t.emails)


@add("thread_digests")
def thread_digests(t: Tables) -> DataFrame:
    return reports.digest(t.threads)


@add("markdown_report")
def markdown_report(t: Tables) -> DataFrame:
    return reports.markdown(threads.build(t.emails), t.emails, "lanes")


@add("markdown_roots")
def markdown_roots(t: Tables) -> DataFrame:
    return reports.markdown(threads.build(t.emails), t.emails, "lanes", replies=False)


@add("bilingual_pages")
def bilingual_pages(t: Tables) -> DataFrame:
    return reports.bilingual_pages(threads.build(t.emails), t.emails, backends.Dictionary({}))


@add("code_report")
def code_report(t: Tables) -> DataFrame:
    return reports.code_report(t.emails)


def _documents(t: Tables) -> DataFrame:
    """A context document for each thread, from its mails."""
    rows = t.emails.where("thread_id <> ''").select(
        c("thread_id").alias("hash"), M.priority_of(c("from_email"), c("subject"), c("body")).alias("priority"), c("id").alias("input_pos"), "subject", c("from_email").alias("from"), "date", "message_id", "in_reply_to", "body"
    ).where("priority > 0")
    heads = t.threads.select(c("id").alias("hash"), "subject", F.lit("").alias("author"), c("start_date").alias("date"), F.lit("").alias("body"), F.lit("").alias("diff"))
    return contexts.pack(heads, rows)


@add("context_packs")
def context_packs(t: Tables) -> DataFrame:
    return _documents(t)


@add("context_trimmed")
def context_trimmed(t: Tables) -> DataFrame:
    return contexts.trim(_documents(t), 6000)


@add("context_parsed")
def context_parsed(t: Tables) -> DataFrame:
    parsed = contexts.parse(_documents(t))
    return parsed.select("hash", F.size("emails").alias("mails"), c("commit")["subject"].alias("subject"))

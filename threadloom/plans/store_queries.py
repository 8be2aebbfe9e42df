"""Queries over the store: listings, pages, counts, statistics, topics, queue and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M
from threadloom.operators import knowledge as K
from threadloom.plans.registry import Registry, Tables

registry = Registry()
add = registry.add
BLANK = "coalesce({0}, '')"


@add("email_by_id", "select id, message_id, subject from emails where id = 7")
def email_by_id(t: Tables) -> DataFrame:
    return K.lookup(t.emails, id=7).select("id", "message_id", "subject")


@add("thread_emails", "select id, message_id, date from emails where thread_id = (select max(thread_id) from emails)")
def thread_emails(t: Tables) -> DataFrame:
    last = t.emails.agg(F.max("thread_id").alias("thread_id"))
    return t.emails.join(F.broadcast(last), "thread_id").select("id", "message_id", "date")


@add("unprocessed_emails", "select id, message_id, subject, created_at from emails where processed = 0 order by created_at, id limit 100")
def unprocessed_emails(t: Tables) -> DataFrame:
    return K.unprocessed(t.emails, 100).select("id", "message_id", "subject", "created_at")


@add("unprocessed_threads", "select id, subject from threads where processed = 0 order by created_at, id limit 50")
def unprocessed_threads(t: Tables) -> DataFrame:
    return K.unprocessed(t.threads, 50).select("id", "subject")


@add("visible_threads", "select count(*) n from threads where hidden = 0")
def visible_threads(t: Tables) -> DataFrame:
    return K.visible(t.threads).agg(F.count("*").alias("n"))


@add("untranslated_threads", "select id, email_count from threads where hidden = 0 and (translated_html_path is null or translated_html_path = '') order by email_count desc nulls last, id limit 100")
def untranslated_threads(t: Tables) -> DataFrame:
    return K.untranslated(t.threads).orderBy(F.desc_nulls_last("email_count"), "id").limit(100).select("id", "email_count")


@add("emails_page", "select id, subject, from_name, substr(body, 1, 300) preview, (select count(*) from emails) total, cast(ceil((select count(*) from emails) / 50.0) as bigint) pages from emails order by date desc nulls last, id offset 50 limit 50")
def emails_page(t: Tables) -> DataFrame:
    return K.page(t.emails, page=2, per_page=50, sort="date").select("id", "subject", "from_name", F.substring("body", 1, 300).alias("preview"), "total", "pages")


@add("emails_search_like", "select id, from_name from emails where subject ilike '%window%' or from_name ilike '%window%' or body ilike '%window%'")
def emails_search_like(t: Tables) -> DataFrame:
    return K.like(t.emails, "window", ["subject", "from_name", "body"]).select("id", "from_name")


@add("emails_sorted", "select id, from_name from emails order by from_name asc nulls first, id limit 50")
def emails_sorted(t: Tables) -> DataFrame:
    return K.page(t.emails, page=1, per_page=50, sort="from_name", order="asc").select("id", "from_name")


@add("emails_unknown_sort", "select id from emails order by date desc nulls last, id limit 50")
def emails_unknown_sort(t: Tables) -> DataFrame:
    return K.page(t.emails, page=1, per_page=50, sort="body; drop table", order="x").select("id")


@add("threads_page", "select id, subject, email_count from threads where hidden = 0 order by start_date desc nulls last, id limit 30")
def threads_page(t: Tables) -> DataFrame:
    return K.page(K.visible(t.threads), 1, 30, sort="start_date", sorts=("start_date", "email_count"), default="start_date").select("id", "subject", "email_count")


@add("recent_emails", "select id, date from emails order by created_at desc nulls last, id limit 20")
def recent_emails(t: Tables) -> DataFrame:
    return t.emails.orderBy(F.desc_nulls_last("created_at"), "id").limit(20).select("id", "date")


@add("recent_summaries", "select id, subject from threads where processed = 1 order by created_at desc nulls last, id limit 10")
def recent_summaries(t: Tables) -> DataFrame:
    return t.threads.where("processed = 1").orderBy(F.desc_nulls_last("created_at"), "id").limit(10).select("id", "subject")


@add("largest_threads", "select id, email_count from threads order by email_count desc nulls last, id limit 10")
def largest_threads(t: Tables) -> DataFrame:
    return t.threads.orderBy(F.desc_nulls_last("email_count"), "id").limit(10).select("id", "email_count")


@add("previews", "select id, substr(body, 1, 200) p200, replace(substr(body, 1, 150), chr(10), ' ') p150, length(body) size from emails")
def previews(t: Tables) -> DataFrame:
    return t.emails.select("id", F.substring("body", 1, 200).alias("p200"), F.translate(F.substring("body", 1, 150), "\n", " ").alias("p150"), F.length("body").cast("bigint").alias("size"))


STATS_SQL = """select (select count(*) from emails) emails, (select count(*) from emails where processed = 1) emails_processed, (select count(*) from threads) threads,
 (select count(*) from threads where hidden = 0) threads_visible, (select count(*) from threads where processed = 1) threads_processed, (select count(*) from topics) topics, (select count(*) from collect_jobs) jobs, (select count(*) from collect_queue) queue"""


@add("kb_stats", STATS_SQL)
def kb_stats(t: Tables) -> DataFrame:
    return K.stats(t.emails, t.threads, t.topics, t.collect_jobs, t.collect_queue)


@add("date_bounds", "select min(date) first_text, max(date) last_text from emails where date <> ''")
def date_bounds(t: Tables) -> DataFrame:
    return t.emails.where("date <> ''").agg(F.min("date").alias("first_text"), F.max("date").alias("last_text"))


@add("date_bounds_utc")
def date_bounds_utc(t: Tables) -> DataFrame:
    return K.dated(t.emails, "date").agg(F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))


@add("top_senders", "select from_email, count(*) n from emails group by 1 order by n desc, from_email nulls last limit 15")
def top_senders(t: Tables) -> DataFrame:
    return K.top(t.emails, "from_email", 15)


@add("score_buckets", "select count(case when relevance_score >= 0.8 then 1 end) high, count(case when relevance_score >= 0.4 and relevance_score < 0.8 then 1 end) medium, count(case when relevance_score < 0.4 then 1 end) low from emails")
def score_buckets(t: Tables) -> DataFrame:
    return K.score_buckets(t.emails)


@add("default_scores", "select id, case when coalesce(relevance_score, 0) = 0 then 0.5 else relevance_score end score from collect_queue")
def default_scores(t: Tables) -> DataFrame:
    return t.collect_queue.select("id", F.when(F.coalesce("relevance_score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("relevance_score")).alias("score"))


@add("topics_with_counts", "select t.id, t.name, coalesce(c.n, 0) thread_count from topics t left join (select topic_id, count(*) n from thread_topics group by 1) c on c.topic_id = t.id")
def topics_with_counts(t: Tables) -> DataFrame:
    return K.topic_counts(t.topics, t.thread_topics)


@add("topic_threads_page", "select t.id, t.subject, l.confidence from threads t join thread_topics l on l.thread_id = t.id where l.topic_id = 3 and t.hidden = 0 order by t.start_date desc nulls last, t.id, l.confidence limit 30")
def topic_threads_page(t: Tables) -> DataFrame:
    both = K.topic_threads(t.threads, t.thread_topics, 3)
    return both.orderBy(F.desc_nulls_last("start_date"), "id", "confidence").limit(30).select("id", "subject", "confidence")


@add("topics_of_threads", "select thread_id, list_sort(list(distinct topic_id)) topic_ids from thread_topics group by 1")
def topics_of_threads(t: Tables) -> DataFrame:
    return t.thread_topics.groupBy("thread_id").agg(F.array_sort(F.collect_set("topic_id")).alias("topic_ids"))


@add("topic_links_last", "select thread_id, topic_id, max(created_at) created_at from thread_topics group by 1, 2")
def topic_links_last(t: Tables) -> DataFrame:
    return K.last_write(t.thread_topics, ["thread_id", "topic_id"], ["created_at", "confidence"]).select("thread_id", "topic_id", "created_at")


@add("topic_keywords", "select id, unnest(from_json(keywords, '[\"VARCHAR\"]')) keyword from topics")
def topic_keywords(t: Tables) -> DataFrame:
    return t.topics.select("id", F.explode(M.json_list(F.col("keywords"))).alias("keyword"))


@add("thread_tags", """select distinct trim(tag) tag from (select unnest(case when coalesce(tags, '') = '' then [] when starts_with(trim(tags), '[') then coalesce(try_cast(case when json_valid(tags) then tags end as varchar[]), [tags]) when starts_with(trim(tags), '"') and json_valid(tags) then [json_extract_string(tags, '$')] else [tags] end) tag from threads) where trim(tag) <> ''""")
def thread_tags(t: Tables) -> DataFrame:
    return t.threads.select(F.explode(M.json_list(F.col("tags"))).alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").distinct()


@add("queue_stats", """select job_id, count(*) filter (status = 'pending') pending, count(*) filter (status = 'downloading') downloading, count(*) filter (status = 'completed') completed,
 count(*) filter (status = 'failed') failed, count(*) total from collect_queue group by 1""")
def queue_stats(t: Tables) -> DataFrame:
    return K.queue_stats(t.collect_queue)


@add("queue_next", "select id, job_id, priority from (select *, row_number() over (partition by job_id order by priority desc nulls last, created_at nulls first, id) rn from collect_queue where status = 'pending') where rn <= 10")
def queue_next(t: Tables) -> DataFrame:
    return K.queue_next(t.collect_queue, "pending", 10).select("id", "job_id", "priority")


@add("queue_retryable", "select id, retry_count from collect_queue where status = 'failed' and retry_count < 3")
def queue_retryable(t: Tables) -> DataFrame:
    return t.collect_queue.where("status = 'failed' and retry_count < 3").select("id", "retry_count")


@add("queue_reset", "select id, case when status in ('downloading', 'failed') then 'pending' else status end status from collect_queue")
def queue_reset(t: Tables) -> DataFrame:
    return K.reset_queue(t.collect_queue).select("id", "status")


@add("queue_unique", "select job_id, root_message_id, min(id) id from collect_queue group by 1, 2")
def queue_unique(t: Tables) -> DataFrame:
    return K.first_write(t.collect_queue, ["job_id", "root_message_id"], ["id"]).select("job_id", "root_message_id", "id")


@add("newest_open_job", "select id, keywords, status from collect_jobs where status <> 'done' order by id desc limit 1")
def newest_open_job(t: Tables) -> DataFrame:
    return t.collect_jobs.where("status <> 'done'").orderBy(F.desc("id")).limit(1).select("id", "keywords", "status")


@add("newest_open_jobs", "select keywords, max(id) id from collect_jobs where status <> 'done' group by 1")
def newest_open_jobs(t: Tables) -> DataFrame:
    return t.collect_jobs.where("status <> 'done'").groupBy("keywords").agg(F.max("id").alias("id"))


@add("progress_cursor", """select id, cast(coalesce(len(k), 0) as int) cursors, list_max(list_transform(k, lambda x: json_extract_string(p, '$."' || x || '".last_date'))) last_date
 from (select id, p, json_keys(p) k from (select id, case when json_valid(progress) then progress end p from collect_jobs))""")
def progress_cursor(t: Tables) -> DataFrame:
    return K.progress_cursor(t.collect_jobs)


NO_MAIL = "not exists (select 1 from emails e where e.thread_id = t.id)"


@add("orphan_threads", f"select id from threads t where hidden = 0 and {NO_MAIL}")
def orphan_threads(t: Tables) -> DataFrame:
    return K.threads_without_mail(t.threads, t.emails).select("id")


@add("orphan_mail_threads", "select count(distinct thread_id) n from emails e where thread_id <> '' and not exists (select 1 from threads t where t.id = e.thread_id)")
def orphan_mail_threads(t: Tables) -> DataFrame:
    return K.mail_without_thread(t.threads, t.emails).agg(F.count_distinct("thread_id").alias("n"))


@add("repair_create", """select thread_id, count(*) email_count, min(date) start_date, max(date) end_date, min(subject) subject, count(distinct from_email) participants from emails e
 where thread_id <> '' and not exists (select 1 from threads t where t.id = e.thread_id) group by 1""")
def repair_create(t: Tables) -> DataFrame:
    return K.repair_create(t.threads, t.emails)


FILED = "(select message_id, min_by(thread_id, id) filed from emails where message_id is not null group by 1)"


@add(
    "repair_actions",
    f"""with empty as (select id, root_message_id root from threads t where hidden = 0 and {NO_MAIL}), filed as {FILED},
 a as (select e.id, e.root, f.filed by_id, g.filed by_root from empty e left join filed f on f.message_id = e.id left join filed g on g.message_id = e.root),
 b as (select id, case when by_id <> '' and by_id <> id then by_id when root <> '' and root <> id and by_root <> '' then by_root end target from a)
 select b.id thread_id, case when target is null then 'HIDE' when x.id is not null then 'HIDE' else 'FIX_ID' end action, case when target is not null and x.id is null then target end new_id from b left join threads x on x.id = b.target""",
)
def repair_actions(t: Tables) -> DataFrame:
    return K.repair_actions(t.threads, t.emails)


@add("thread_batches", "select (row_number() over (order by id) - 1) // 50 batch, id from threads where processed = 1")
def thread_batches(t: Tables) -> DataFrame:
    return K.numbered(t.threads.where("processed = 1"), "id").select(F.expr("(n - 1) div 50").alias("batch"), "id")


@add("batch_rollup", """select batch, count(*) threads, cast(sum(email_count) as bigint) mails from (select (row_number() over (order by id) - 1) // 50 batch, email_count from threads where processed = 1) group by 1""")
def batch_rollup(t: Tables) -> DataFrame:
    return K.numbered(t.threads.where("processed = 1"), "id").groupBy(F.expr("(n - 1) div 50").alias("batch")).agg(F.count("*").alias("threads"), F.sum("email_count").alias("mails"))


@add("cache_sizes", "select backend, count(*) entries, cast(sum(access_count) as bigint) reads from translation_cache group by 1")
def cache_sizes(t: Tables) -> DataFrame:
    return t.translation_cache.groupBy("backend").agg(F.count("*").alias("entries"), F.sum(F.col("access_count").cast("bigint")).alias("reads"))


@add("cache_lookup", """select p.paragraph_id, b.backend, c.translated, c.cache_key is not null hit from paragraphs p, (select distinct backend from translation_cache where backend = 'api_alpha') b
 left join translation_cache c on c.cache_key = sha256(b.backend || ':' || p.text_orig)""")
def cache_lookup(t: Tables) -> DataFrame:
    return K.cache_lookup(t.paragraphs.withColumn("backend", F.lit("api_alpha")), t.translation_cache, "text_orig").select("paragraph_id", "backend", "translated", "hit")


@add("cache_misses", "select distinct sha256('api_alpha:' || text_orig) cache_key from paragraphs where sha256('api_alpha:' || text_orig) not in (select cache_key from translation_cache)")
def cache_misses(t: Tables) -> DataFrame:
    found = K.cache_lookup(t.paragraphs.withColumn("backend", F.lit("api_alpha")), t.translation_cache, "text_orig")
    return found.where("not hit and cache_key is not null").select("cache_key").distinct()


@add("sender_facets", "select list_name, trim(split_part(coalesce(from_email, ''), '<', 1)) name, count(*) n from emails group by 1, 2")
def sender_facets(t: Tables) -> DataFrame:
    return t.emails.groupBy("list_name", M.stored_name(F.coalesce("from_email", F.lit(""))).alias("name")).agg(F.count("*").alias("n"))


@add("prev_next_paragraph", """select paragraph_id, lag(text_orig) over w before, lead(text_orig) over w after from (select *, row_number() over (partition by email_id, para_no order by paragraph_id) r from paragraphs)
 window w as (partition by email_id order by para_no, paragraph_id)""")
def prev_next_paragraph(t: Tables) -> DataFrame:
    w = W.partitionBy("email_id").orderBy("para_no", "paragraph_id")
    return t.paragraphs.select("paragraph_id", F.lag("text_orig").over(w).alias("before"), F.lead("text_orig").over(w).alias("after"))


@add("related_orders", """select a.o_orderkey, b.o_orderkey related from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey
 and b.o_orderdate between a.o_orderdate - interval 7 day and a.o_orderdate + interval 7 day""")
def related_orders(t: Tables) -> DataFrame:
    return K.within_days(t.orders, "o_custkey", "o_orderkey", "o_orderdate", 7).select("o_orderkey", "related")


@add("asof_previous_event", "select e.event_id, p.event_id previous from events e asof left join (select event_id, user_id, max(ts) ts from events group by 1, 2) p on e.user_id = p.user_id and e.ts > p.ts")
def asof_previous_event(t: Tables) -> DataFrame:
    return K.previous(t.events, "user_id", "ts", "event_id")


@add("search_terms_of_mails", "select id, regexp_extract(lower(coalesce(subject, '')), '^([a-z]+):', 1) area from emails")
def search_terms_of_mails(t: Tables) -> DataFrame:
    return t.emails.select("id", F.regexp_extract(F.lower(F.coalesce("subject", F.lit(""))), "^([a-z]+):", 1).alias("area"))

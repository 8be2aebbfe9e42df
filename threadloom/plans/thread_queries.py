"""Queries of reply trees, filters of listings, prompts and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M
from threadloom.operators import knowledge as K
from threadloom.operators import listings, threads, trees
from threadloom.plans.registry import Registry, Tables
from threadloom.plans.text_queries import THREADS_SQL

registry = Registry()
add = registry.add
c = F.col

#: Every tree as ways from its root, of ids in stored order; mails on a circle are roots.
WAYS_SQL = f"""{THREADS_SQL}, cutoff as (select mid, case when depth > 0 then parent end parent, (select id from first f where f.node = mid) id from built),
way(mid, root, ids, mids) as (select mid, mid, [id], [mid] from cutoff where parent is null
 union all select k.mid, w.root, list_append(w.ids, k.id), list_append(w.mids, k.mid) from way w join cutoff k on k.parent = w.mid)"""


@add("subtree_size", f"{WAYS_SQL} select node, count(*) size from (select unnest(mids) node from way) group by 1")
def subtree_size(t: Tables) -> DataFrame:
    return trees.subtree_sizes(trees.forest(threads.build(t.emails)))


@add("thread_depth_hist", f"{THREADS_SQL} select cast(depth as int) depth, count(*) mails from built group by 1")
def thread_depth_hist(t: Tables) -> DataFrame:
    return trees.depth_histogram(threads.build(t.emails))


@add("thread_dfs", f"{WAYS_SQL} select mid node, row_number() over (partition by root order by ids) place from way")
def thread_dfs(t: Tables) -> DataFrame:
    return trees.depth_first(trees.forest(threads.build(t.emails)), "id")


@add("thread_dfs_by_date")
def thread_dfs_by_date(t: Tables) -> DataFrame:
    return trees.depth_first(trees.forest(threads.build(t.emails)), F.asc_nulls_first("sent_at"), "id")


@add("threads_by_root_date")
def threads_by_root_date(t: Tables) -> DataFrame:
    return trees.by_root_date(threads.build(t.emails))


@add("dashboard_totals", "select count(*) cards, coalesce(sum(email_count), 0) mails, count(*) filter (processed = 1) translated, count(distinct nullif(split_part(coalesce(subject, ''), ':', 1), '')) areas from threads where hidden = 0")
def dashboard_totals(t: Tables) -> DataFrame:
    return listings.totals(t.threads.where("hidden = 0").withColumn("area", F.nullif(F.split_part(F.coalesce("subject", F.lit("")), F.lit(":"), F.lit(1)), F.lit(""))), "email_count", c("processed") == 1, "area")


@add("cache_hit_rate", """select l.backend, count(*) lookups, count(c.cache_key) hits, round(count(c.cache_key) / count(*), 6) rate from (
 select b.backend backend, sha256(b.backend || ':' || p.text_orig) k from paragraphs p cross join (select distinct backend from translation_cache where backend is not null) b where p.text_orig is not null) l
 left join translation_cache c on c.cache_key = l.k group by 1""")
def cache_hit_rate(t: Tables) -> DataFrame:
    return K.hit_rates(t.paragraphs, t.translation_cache)


@add("answer_parts", """select cache_key, split_part(trim(translated, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1) subject,
 case when contains(trim(translated, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) then substr(trim(translated, ' ' || chr(9) || chr(10) || chr(13)), instr(trim(translated, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) + 1) else '' end body
 from translation_cache where regexp_full_match(translated, '[^\\x{85}\\x{a0}\\x{3000}\\v\\f]*')""")
def answer_parts(t: Tables) -> DataFrame:
    rows = t.translation_cache.where(~F.col("translated").rlike(r"[\x{85}\x{a0}\x{3000}\x0b\f]"))
    return rows.select("cache_key", M.answer_parts(c("translated")).alias("p")).select("cache_key", "p.*")


PROMPT_SQL = """select thread_id, string_agg(case when place = 1 then '# ' || coalesce(subject, '') || chr(10) else '' end || '[' || coalesce(from_name, '') || ']' || chr(10) || substr(coalesce(body, ''), 1, case when place = 1 then {0} else {2} end), chr(10) || chr(10) order by place) text
 from (select *, row_number() over (partition by thread_id order by id) place from emails where thread_id <> '') where place <= {1} + 1 group by 1"""


@add("summary_prompts", PROMPT_SQL.format(500, 5, 300))
def summary_prompts(t: Tables) -> DataFrame:
    return listings.thread_prompts(t.emails, root=500, replies=5, size=300)


@add("answer_contexts", PROMPT_SQL.format(3000, 10, 2000))
def answer_contexts(t: Tables) -> DataFrame:
    return listings.thread_prompts(t.emails, root=3000, replies=10, size=2000)


@add("mail_filter", """select id from emails where (contains(lower(coalesce(from_name, '')), 'lanes') or contains(lower(coalesce(subject, '')), 'lanes') or contains(lower(substr(coalesce(body, ''), 1, 200)), 'lanes'))
 and contains(lower(coalesce(from_name, '')), 'e') and (upper(coalesce(priority, '')) not like '%HIGH%' and (upper(coalesce(priority, '')) like '%LOW%' or upper(coalesce(subject, '')) like '%PATCH%'))""")
def mail_filter(t: Tables) -> DataFrame:
    return listings.mail_filter(t.emails, "Lanes", author="E", tag="[PATCH摘要]").select("id")


@add("card_filter", "select id from threads where (contains(lower(coalesce(subject, '')), 'quota') or contains(lower(coalesce(summary_zh, '')), 'quota') or contains(lower(coalesce(tags, '')), 'quota')) and processed = 1 and starts_with(lower(coalesce(subject, '')), 're:') = false")
def card_filter(t: Tables) -> DataFrame:
    return listings.card_filter(t.threads, "quota", processed=1).where(~F.lower(F.coalesce("subject", F.lit(""))).startswith("re:")).select("id")


@add("cards_by_mails", "select id, row_number() over (order by email_count desc nulls last, id) place from threads where hidden = 0")
def cards_by_mails(t: Tables) -> DataFrame:
    return listings.sorted_cards(t.threads.where("hidden = 0"), "mails").select("id", "place")


@add("cards_by_subject", "select id, row_number() over (order by coalesce(subject, ''), id) place from threads where hidden = 0")
def cards_by_subject(t: Tables) -> DataFrame:
    return listings.sorted_cards(t.threads.where("hidden = 0"), "subject").select("id", "place")


@add("cards_by_date", "select id, row_number() over (order by end_date desc nulls last, id) place from threads where hidden = 0")
def cards_by_date(t: Tables) -> DataFrame:
    return listings.sorted_cards(t.threads.where("hidden = 0"), "date").select("id", "place")


@add("small_diffs", "select id, length(substr(body, instr(body, 'diff --git '))) diff_size from emails where contains(body, 'diff --git ') and length(substr(body, instr(body, 'diff --git '))) <= 8192")
def small_diffs(t: Tables) -> DataFrame:
    return listings.small_diffs(t.emails).select("id", "diff_size")


@add("unfinished_threads", "select id from threads where coalesce(trim(translated_html_path), '') = ''")
def unfinished_threads(t: Tables) -> DataFrame:
    from threadloom.streaming import collect

    return collect.unfinished(t.threads).select("id")


@add("timeouts", "select thread_id, least(120 + 60 * count(*), 1800) thread_seconds, max(least(60 + 10 * (length(coalesce(body, '')) // 1024), 300)) mail_seconds from emails where thread_id <> '' group by 1")
def timeouts(t: Tables) -> DataFrame:
    return listings.timeouts(t.emails)

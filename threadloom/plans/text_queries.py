"""Queries of the text and search operators and of threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import mailtext as M
from threadloom.operators import search, threads
from threadloom.plans.data_quality import ONE_FORM, WALK_SQL
from threadloom.plans.registry import Registry, Tables
from threadloom.tables import clean

registry = Registry()
add = registry.add
c = F.col
PERF = " or ".join(f"contains(lower(substr(b, 1, 3000)), '{w}')" for w in M.PERFORMANCE)

PRIORITY_SQL = f"""case when contains(f, 'tip-bot') then 0 when (contains(f, 'kernel test robot') or contains(f, 'lkp@intel')) then case when contains(lower(b), 'warning:') or contains(lower(b), 'error:') then 1 else 0 end
 when regexp_matches(s, '(?i)\\[.*PATCH.*\\s+0+/\\d+\\]') then 2 when regexp_matches(s, '(?i)\\[(?:RFC\\s*)?(?:PATCH|RESEND)') and (contains(b, 'diff --git') or contains(b, chr(10) || '--- a/')) then 1
 when {PERF} then 2 else 3 end priority from (select id, body, lower(coalesce(from_email, '')) f, coalesce(subject, '') s, coalesce(body, '') b from emails)"""
STRIP = "regexp_replace({0}, '^[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]+$', '', 'g')"
BASE_SQL = STRIP.format("regexp_replace(coalesce(subject, ''), '^(?i:(?:Re:\\s*)+)', '')")
FILES_SQL = f"""files as (select id, p from (select id, unnest(regexp_extract_all(coalesce(body, ''), '{M.DIFF_PATHS}', 2) || regexp_extract_all(coalesce(body, ''), '{M.PATCH_PATHS}', 1)
 || list_transform(list_filter(regexp_extract_all(coalesce(body, ''), '(?:^|\\W)(?:kernel|drivers|include|mm|fs|net|arch|block|crypto|lib|security|sound|tools|scripts|init|ipc)/[\\w/._-]+\\.[chS](?:\\W|$)'), lambda x: true), lambda x: regexp_extract(x, '((?:kernel|drivers|include|mm|fs|net|arch|block|crypto|lib|security|sound|tools|scripts|init|ipc)/[\\w/._-]+\\.[chS])', 1))) p from emails)
 where regexp_matches(p, '\\.[chS]$') group by 1, 2)"""
AREA_SQL = "case " + " ".join(f"when starts_with(p, '{k}') then '{v}'" for k, v in M.SUBSYSTEMS.items()) + " end"


@add(
    "mail_priority",
    f"""select id, case when contains(f, 'tip-bot') then 0 when (contains(f, 'kernel test robot') or contains(f, 'lkp@intel')) then case when contains(lower(b), 'warning:') or contains(lower(b), 'error:') then 1 else 0 end
 when regexp_matches(s, '(?i)\\[.*PATCH.*\\s+0+/\\d+\\]') then 2 when regexp_matches(s, '(?i)\\[(?:RFC\\s*)?(?:PATCH|RESEND)') and (contains(b, 'diff --git') or contains(b, chr(10) || '--- a/')) then 1
 when {PERF} then 2 else 3 end priority from (select id, lower(coalesce(from_email, '')) f, coalesce(subject, '') s, coalesce(body, '') b from emails)""",
)
def mail_priority(t: Tables) -> DataFrame:
    return t.emails.select("id", M.priority_of(c("from_email"), c("subject"), c("body")).alias("priority"))


@add("preprocess_stats", f"select count(*) total, count(*) filter (priority = 0) dropped, count(*) filter (priority = 1) low, count(*) filter (priority = 2) medium, count(*) filter (priority = 3) high from (select {PRIORITY_SQL})")
def preprocess_stats(t: Tables) -> DataFrame:
    p = M.priority_of(c("from_email"), c("subject"), c("body"))
    return t.emails.select(p.alias("p")).agg(F.count("*").alias("total"), *[F.count_if(c("p") == v).alias(k) for k, v in (("dropped", M.DROP), ("low", M.LOW), ("medium", M.MEDIUM), ("high", M.HIGH))])


@add("mail_tags", "select id, case when upper(coalesce(priority, '')) like '%HIGH%' then '[讨论]' when upper(coalesce(priority, '')) like '%LOW%' or upper(coalesce(subject, '')) like '%PATCH%' then '[PATCH摘要]' else '[概述/数据]' end tag from emails")
def mail_tags(t: Tables) -> DataFrame:
    return t.emails.select("id", M.tag_of_row(c("priority"), c("subject")).alias("tag"))


@add("mail_budgets", f"select id, budget, substr(body, 1, budget) kept from (select id, body, [0, 500, 2000, 5000][priority + 1] budget from (select id, body, {PRIORITY_SQL}))")
def mail_budgets(t: Tables) -> DataFrame:
    p = M.priority_of(c("from_email"), c("subject"), c("body"))
    return t.emails.select("id", M.budget_of(p).alias("budget"), F.substring(c("body"), F.lit(1), M.budget_of(p)).alias("kept"))


@add("without_signature", "select id, regexp_replace(split_part(body, chr(10) || '-- ' || chr(10), 1), '\\s+$', '') text from emails where body is not null")
def without_signature(t: Tables) -> DataFrame:
    return t.emails.where("body is not null").select("id", M.without_signature(c("body")).alias("text"))


@add("base_subjects", f"select id, {BASE_SQL} base from emails")
def base_subjects(t: Tables) -> DataFrame:
    return t.emails.select("id", M.base_subject(c("subject")).alias("base"))


@add("group_subjects", f"""select case when length(b) <= 60 then b when contains(substr(b, 1, 60), ' ') and 60 - instr(reverse(substr(b, 1, 60)), ' ') > 40 then substr(b, 1, 60 - instr(reverse(substr(b, 1, 60)), ' ')) else substr(b, 1, 60) end subject, count(*) n from (select {BASE_SQL} b from emails) group by 1""")
def group_subjects(t: Tables) -> DataFrame:
    return t.emails.groupBy(M.group_subject(c("subject")).alias("subject")).agg(F.count("*").alias("n"))


@add("reply_depths", "select id, len(regexp_extract_all(lower(coalesce(subject, '')), 're:')) depth from emails")
def reply_depths(t: Tables) -> DataFrame:
    return t.emails.select("id", M.reply_depth(c("subject")).cast("bigint").alias("depth"))


@add("patch_tags", """select id, coalesce(try_cast(regexp_extract(s, p, 2) as int), 0) number, coalesce(try_cast(regexp_extract(s, p, 3) as int), 0) total, regexp_extract(s, p, 1) version from (select id, coalesce(subject, '') s, '(?i)\\[PATCH(?:\\s+(v\\d+))?(?:\\s+\\d+/\\d+)*\\s*(\\d+)/(\\d+)\\]' p from emails)""")
def patch_tags(t: Tables) -> DataFrame:
    return t.emails.select("id", M.patch_tag(c("subject")).alias("p")).select("id", "p.number", "p.total", "p.version")


@add("patch_order", f"select id, cast(case when n is null then 1 else 0 end as int) kind, coalesce(n, 0) number, email_count from (select id, email_count, try_cast(regexp_extract(coalesce(subject, ''), '{M.PATCH_NUMBER}', 1) as int) n from threads)")
def patch_order(t: Tables) -> DataFrame:
    return t.threads.select("id", M.patch_sort_key(c("subject")).alias("key"), "email_count").select("id", "key.kind", "key.number", "email_count")


@add("reply_targets", f"""select id, lower(case when a <> '' then a else w end) target from (select id, w, regexp_extract(w, '<([^>]+)>', 1) a from (select id, {STRIP.format(f"regexp_extract(coalesce(body, ''), '{M.REPLY_LINE}', 1)")} w from emails)) where w <> ''""")
def reply_targets(t: Tables) -> DataFrame:
    return t.emails.select("id", M.reply_target(c("body")).alias("target")).where("target <> ''")


@add("code_files", f"with {FILES_SQL} select p file, count(*) n from files group by 1")
def code_files(t: Tables) -> DataFrame:
    return t.emails.select(F.explode(M.code_files(c("body"))).alias("file")).groupBy("file").agg(F.count("*").alias("n"))


@add("code_functions", f"select function, count(*) n from (select distinct id, {STRIP.format('f')} function from (select id, unnest(regexp_extract_all(coalesce(body, ''), '{M.HUNK_CONTEXT}', 1)) f from emails)) where function <> '' group by 1")
def code_functions(t: Tables) -> DataFrame:
    return t.emails.select(F.explode(M.code_functions(c("body"))).alias("function")).groupBy("function").agg(F.count("*").alias("n"))


@add("patch_mails", "select id from emails where regexp_matches(coalesce(body, ''), 'diff --git a/([\\w/._-]+) b/([\\w/._-]+)') or contains(coalesce(subject, ''), '[PATCH')")
def patch_mails(t: Tables) -> DataFrame:
    return t.emails.where(M.is_patch(c("subject"), c("body"))).select("id")


@add("diff_subsystems", f"with {FILES_SQL} select id, list_sort(list(distinct area)) areas from (select id, {AREA_SQL} area from files) where area is not null group by 1")
def diff_subsystems(t: Tables) -> DataFrame:
    return t.emails.select("id", M.subsystems(M.code_files(c("body"))).alias("areas")).where("size(areas) > 0")


@add("licence_documents", "select doc_id from (select doc_id, " + " + ".join(f"cast(contains(lower(coalesce(text, '')), '{w}') as int)" for w in M.LICENCE_WORDS) + " n from documents) where n >= 2")
def licence_documents(t: Tables) -> DataFrame:
    return t.documents.where(M.is_licence(c("text"))).select("doc_id")


UNWANTED = "(?i)" + "|".join(M.UNWANTED_SUBJECTS)
WANTED_SQL = "lower(coalesce(subject, '') || ' ' || substr(coalesce(body, ''), 1, 2000))"


@add("rule_filter_two_layer", f"select id from emails where not regexp_matches(coalesce(subject, ''), '{UNWANTED}') and (contains({WANTED_SQL}, 'lanes') or contains({WANTED_SQL}, 'slabring')) and (contains({WANTED_SQL}, 'latency') or contains({WANTED_SQL}, 'budget'))")
def rule_filter_two_layer(t: Tables) -> DataFrame:
    return t.emails.where(M.wanted(c("subject"), c("body"), [], subsystem=["lanes", "Slabring"], topic=["latency", "budget"])).select("id")


@add("rule_filter_any", f"select id from emails where not regexp_matches(coalesce(subject, ''), '{UNWANTED}|quota:') and contains({WANTED_SQL}, 'throttle')")
def rule_filter_any(t: Tables) -> DataFrame:
    return t.emails.where(M.wanted(c("subject"), c("body"), ["throttle"], unwanted=["quota:"])).select("id")


@add("boolean_and", "select id from emails where contains(lower(coalesce(subject, '')), 'lease') and contains(lower(coalesce(subject, '')), 'readers')")
def boolean_and(t: Tables) -> DataFrame:
    return t.emails.where(M.matches_keywords(c("subject"), "lease AND readers")).select("id")


@add("boolean_or", "select id from emails where contains(lower(coalesce(subject, '')), 'meter') or contains(lower(coalesce(subject, '')), 'tarn')")
def boolean_or(t: Tables) -> DataFrame:
    return t.emails.where(M.matches_keywords(c("subject"), "meter OR Tarn")).select("id")


@add("author_filter", "select id, from_email from emails where contains(lower(from_email), 'kestrelworks')")
def author_filter(t: Tables) -> DataFrame:
    return t.emails.where(F.contains(F.lower("from_email"), F.lit("kestrelworks"))).select("id", "from_email")


@add("html_escaped", "select id, replace(replace(replace(replace(coalesce(subject, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') html from emails")
def html_escaped(t: Tables) -> DataFrame:
    return t.emails.select("id", M.escape_html(c("subject")).alias("html"))


@add("safe_names", "select id, substr(regexp_replace(id, '[^a-zA-Z0-9_\\-]', '_', 'g'), 1, 80) thread_name, substr(regexp_replace(id, '[<>:\"/\\\\|?*\\s]', '_', 'g'), 1, 120) web_name, substr(regexp_replace(id, '[<>@/\\\\]', '_', 'g'), 1, 80) mail_name from threads")
def safe_names(t: Tables) -> DataFrame:
    return t.threads.select("id", *[M.safe_name(c("id"), s).alias(f"{s}_name") for s in ("thread", "web", "mail")])


@add("contained_ids", "select id, case when m = '' then '' else (case when starts_with(m, '<') then '' else '<' end) || m || (case when ends_with(m, '>') then '' else '>' end) end mid from (select id, trim(coalesce(message_id, ''), ' ' || chr(9) || chr(10) || chr(13)) m from emails)")
def contained_ids(t: Tables) -> DataFrame:
    return t.emails.select("id", M.contained_id(c("message_id")).alias("mid"))


@add("stored_names", "select id, trim(split_part(from_email, '<', 1)) name from emails where from_email is not null")
def stored_names(t: Tables) -> DataFrame:
    return t.emails.where("from_email is not null").select("id", M.stored_name(c("from_email")).alias("name"))


@add("cache_keys", "select paragraph_id, sha256('mt_local:' || text_orig) cache_key, substr(sha256(text_orig), 1, 16) source_hash from paragraphs where text_orig is not null")
def cache_keys(t: Tables) -> DataFrame:
    return t.paragraphs.where("text_orig is not null").select("paragraph_id", M.cache_key(F.lit("mt_local"), c("text_orig")).alias("cache_key"), M.source_hash(c("text_orig")).alias("source_hash"))


@add("list_names", "select distinct list_name, list_name resolved from emails where list_name is not null")
def list_names(t: Tables) -> DataFrame:
    return t.emails.where("list_name is not null").select("list_name", M.list_name(c("list_name")).alias("resolved")).distinct()


@add("paragraph_split", f"select id, cast(pos - 1 as int) pos, paragraph from (select id, unnest(l) paragraph, generate_subscripts(l, 1) pos from (select id, list_filter(regexp_split_to_array({STRIP.format("coalesce(body, '')")}, '\\n\\n+'), lambda x: {STRIP.format('x')} <> '') l from emails))")
def paragraph_split(t: Tables) -> DataFrame:
    return t.emails.select("id", F.posexplode(M.paragraphs(c("body"))).alias("pos", "paragraph"))


@add("translation_scores")
def translation_scores(t: Tables) -> DataFrame:
    from threadloom.operators import knowledge as K

    found = K.cache_lookup(t.paragraphs.withColumn("backend", F.lit("api_alpha")), t.translation_cache, "text_orig").where("hit")
    return found.select("paragraph_id", F.round(M.translation_score(c("translated"), c("text_orig")), 6).alias("score"))


LINES_SQL = lambda text: f"list_distinct(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> ''))"


@add("line_overlap", f"""select paragraph_id, len(b) > 0 and len(list_intersect(a, b)) >= 0.8 * len(b) same from (
 select p.paragraph_id, {LINES_SQL('c.translated')} a, {LINES_SQL('p.text_orig')} b from paragraphs p join translation_cache c on c.cache_key = sha256('api_alpha:' || p.text_orig) where c.translated is not null)""")
def line_overlap(t: Tables) -> DataFrame:
    from threadloom.operators import knowledge as K

    found = K.cache_lookup(t.paragraphs.withColumn("backend", F.lit("api_alpha")), t.translation_cache, "text_orig").where("hit and translated is not null")
    return found.select("paragraph_id", M.shares_lines(c("translated"), c("text_orig")).alias("same"))


FTS = "list_contains({0}, '{1}')"
TOKENS = "regexp_extract_all(lower(coalesce(subject, '')), '[\\p{L}\\p{N}]+') || regexp_extract_all(lower(coalesce(substr(body, 1, 2000), '')), '[\\p{L}\\p{N}]+')"


@add("fts_words", f"select id from (select id, {TOKENS} w from emails) where list_contains(w, 'reboots') and list_contains(w, 'lanes')")
def fts_words(t: Tables) -> DataFrame:
    return search.search(t.emails, "reboots lanes").select("id")


@add("fts_prefix", f"select id from (select id, {TOKENS} w from emails) where len(list_filter(w, lambda x: starts_with(x, 'throttl'))) > 0")
def fts_prefix(t: Tables) -> DataFrame:
    return search.search(t.emails, "throttl*").select("id")


@add("fts_not", f"select id from (select id, {TOKENS} w from emails) where list_contains(w, 'quota') and not list_contains(w, 'patch')")
def fts_not(t: Tables) -> DataFrame:
    return search.search(t.emails, "quota NOT patch").select("id")


@add("fts_or_column", "select id from emails where list_contains(regexp_extract_all(lower(coalesce(subject, '')), '[\\p{L}\\p{N}]+'), 'meter') or list_contains(regexp_extract_all(lower(coalesce(subject, '')), '[\\p{L}\\p{N}]+'), 'tarn')")
def fts_or_column(t: Tables) -> DataFrame:
    return search.search(t.emails, "subject:meter OR subject:tarn").select("id")


SPACED = "' ' || array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


@add("fts_phrase", f"select id from emails where contains({SPACED.format('subject')}, ' stale cursor ') or contains({SPACED.format('substr(body, 1, 2000)')}, ' stale cursor ')")
def fts_phrase(t: Tables) -> DataFrame:
    return search.search(t.emails, '"stale cursor"').select("id")


@add("fts_near")
def fts_near(t: Tables) -> DataFrame:
    return search.search(t.emails, "NEAR(mutex deliberate, 8)").select("id")


@add("fts_fallback", "select id from emails where subject ilike '%sealfs/%' or body ilike '%sealfs/%' order by date desc nulls last, id limit 50")
def fts_fallback(t: Tables) -> DataFrame:
    return search.search_or_like(t.emails, "sealfs/").select("id")


@add("index_tokens")
def index_tokens(t: Tables) -> DataFrame:
    return search.index(t.emails).groupBy("token").agg(F.count_distinct("doc").alias("docs"))


THREADS_SQL = f"""with recursive mails as (select {ONE_FORM("message_id")} node, id, {ONE_FORM("in_reply_to")} reply, from_email,
 list_filter(list_transform(regexp_split_to_array(coalesce(refs, ''), '[\\s,]+'), lambda v: {ONE_FORM("v")}), lambda v: v is not null) refs from emails),
first as (select node, min(id) id, arg_min(struct_pack(reply := reply, refs := refs, sender := from_email), id) m from mails where node is not null group by node),
named as (select distinct unnest(m.refs) node from first),
wish as (select node, coalesce(m.reply, case when node in (select node from named) then m.refs[len(m.refs)] end) parent from first),
link as (select node, case when parent in (select node from first) then parent end parent from wish), {WALK_SQL},
built as (select l.node mid, l.parent, coalesce(w.root_id, r.root_id) root, coalesce(w.depth, 0) depth, f.m.sender sender from link l left join walk w on w.node = l.node left join ring r on r.node = l.node join first f on f.node = l.node)"""


@add("thread_roots", f"{THREADS_SQL} select mid, parent, root, cast(depth as int) depth from built")
def thread_roots(t: Tables) -> DataFrame:
    return threads.build(t.emails).select("mid", "parent", "root", "depth")


@add("thread_summary")
def thread_summary(t: Tables) -> DataFrame:
    return threads.summaries(threads.build(t.emails))


@add("report_overview", f"{THREADS_SQL} select count(distinct root) threads, count(*) mails, count(distinct sender) participants from built")
def report_overview(t: Tables) -> DataFrame:
    return threads.overview(threads.build(t.emails))


@add("busiest_participants", f"{THREADS_SQL} select sender from_email, count(distinct root) threads from built where sender is not null group by 1 order by threads desc, from_email limit 10")
def busiest_participants(t: Tables) -> DataFrame:
    return threads.busiest(threads.build(t.emails))


@add("thread_sizes", f"{THREADS_SQL} select root, count(*) email_count, list_sort(list(distinct sender) filter (sender is not null)) participants from built group by 1")
def thread_sizes(t: Tables) -> DataFrame:
    return threads.summaries(threads.build(t.emails)).select("root", "email_count", "participants")


@add("thread_first_mails")
def thread_first_mails(t: Tables) -> DataFrame:
    return threads.first_n(threads.build(t.emails), 5).select("root", "mid", "place")


@add("subject_tree")
def subject_tree(t: Tables) -> DataFrame:
    return threads.subject_tree(t.emails)


@add("mail_roots_for_queue", "select id, case when coalesce(trim(refs), '') = '' then message_id else regexp_split_to_array(trim(refs), '[\\s,]+')[1] end root from emails where message_id is not null")
def mail_roots_for_queue(t: Tables) -> DataFrame:
    refs = F.split(clean(F.coalesce("refs", F.lit(""))), r"[\s,]+")
    return t.emails.where("message_id is not null").select("id", F.when(F.coalesce(clean(c("refs")), F.lit("")) == "", c("message_id")).otherwise(F.get(refs, 0)).alias("root"))


@add("tpch_revenue", "select l_returnflag, l_linestatus, count(*) n, sum(l_quantity) quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def tpch_revenue(t: Tables) -> DataFrame:
    rows = t.lineitem.where(c("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))

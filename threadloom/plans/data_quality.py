"""Queries of the general data problems: timestamps, references, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import hierarchy, references, timestamps
from threadloom.plans.registry import Registry, Tables
from threadloom.tables import cut

registry = Registry()

ONE = "'<' || regexp_replace({0}, '^[\\s<]+|[\\s>]+$', '', 'g') || '>'"
ONE_FORM = lambda c: f"nullif({ONE.format(c)}, '<>')"

LINKS_SQL = f"""
links as (
  select 'emails' rec_table, 'thread_id' rec_field, cast(id as varchar) rec_key, 'thread' target, {ONE_FORM("thread_id")} as k, created_at at_ from emails
  union all select 'emails', 'in_reply_to', cast(id as varchar), 'mail', {ONE_FORM("in_reply_to")}, created_at from emails
  union all select 'threads', 'root_message_id', id, 'mail', {ONE_FORM("root_message_id")}, created_at from threads
  union all select 'threads', 'id', id, 'filed', {ONE_FORM("id")}, created_at from threads),
parents as (
  select target, k, min(at_) first_at from (
    select 'mail' target, {ONE_FORM("message_id")} k, created_at at_ from emails
    union all select 'thread', {ONE_FORM("id")}, created_at from threads
    union all select 'filed', {ONE_FORM("thread_id")}, created_at from emails) where k is not null group by 1, 2),
gone as (select distinct record_kind target, {ONE_FORM("record_key")} k from removals),
found as (
  select rec_table, rec_field, rec_key, at_, case when p.k is not null then 'late' when g.k is not null then 'deleted' else 'missing' end state
  from links l left join parents p on l.target = p.target and l.k = p.k left join gone g on l.target = g.target and l.k = g.k
  where l.k is not null and (p.k is null or p.first_at > l.at_))
"""


@registry.add("p1_found")
def p1_found(t: Tables) -> DataFrame:
    return timestamps.odd_instants(t.emails, t.threads)


@registry.add("p1_states")
def p1_states(t: Tables) -> DataFrame:
    known = timestamps.normalise(timestamps.dated_fields(t.emails, t.threads), "value", F.concat_ws(".", "rec_table", "rec_field"))
    return known.groupBy("rec_table", "rec_field", "state", F.coalesce("layout", F.lit("none")).alias("layout")).agg(F.count("*").alias("n"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us"))


@registry.add("p2_found", f"with {LINKS_SQL} select rec_table, rec_field, rec_key, state from found")
def p2_found(t: Tables) -> DataFrame:
    return references.orphans(t.emails, t.threads, t.removals).select("rec_table", "rec_field", "rec_key", "state")


@registry.add("p2_report", f"with {LINKS_SQL} select rec_table, rec_field, state, strftime(make_timestamp(cast(floor(at_) as bigint) * 1000000), '%Y-%m') period, count(*) n from found group by all")
def p2_report(t: Tables) -> DataFrame:
    return references.orphan_counts(references.orphans(t.emails, t.threads, t.removals))


CHAIN_SQL = f"""
mails as (
  select {ONE_FORM("message_id")} node, id, {ONE_FORM("in_reply_to")} reply, refs from emails),
first as (select node, min(id) id, arg_min(struct_pack(reply := reply, refs := refs), id) m from mails where node is not null group by node),
named as (
  select node, max_by(x.ref, x.pos) ref from (
    select node, unnest(list_transform(regexp_split_to_array(coalesce(m.refs, ''), '[\\s,]+'), lambda v, i: struct_pack(ref := {ONE_FORM("v")}, pos := i))) x from first)
  where x.ref in (select node from first) group by node),
link as (select f.node, case when f.m.reply in (select node from first) then f.m.reply else n.ref end parent from first f left join named n on f.node = n.node),
"""


#: Roots and depths of a table link(node, parent); -1 and the circle's smallest id at or below a circle.
WALK_SQL = """
walk(node, root_id, depth) as (
  select node, node, 0 from link where parent is null
  union all select l.node, w.root_id, w.depth + 1 from walk w join link l on l.parent = w.node),
lost as (select * from link where node not in (select node from walk)),
jump(node, at_, seen, depth) as (
  select node, parent, [node], 1 from lost
  union all select j.node, l.parent, list_append(j.seen, j.at_), j.depth + 1 from jump j join lost l on l.node = j.at_ where not list_contains(j.seen, j.at_)),
ring as (select node, list_min(seen[list_position(seen, at_):]) root_id from jump where list_contains(seen, at_))
"""


@registry.add(
    "p4_found",
    f"""with recursive {CHAIN_SQL} {WALK_SQL}
select node message_id, root_id, cast(depth as int) depth from walk where depth > 0
union all select node, root_id, cast(-1 as int) from ring""",
)
def p4_found(t: Tables) -> DataFrame:
    links = cut(hierarchy.parent_links(t.emails))
    solved = hierarchy.resolve(links)
    return solved.where("parent is not null").select(F.col("node").alias("message_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


PATHS_SQL = """trail(node, root_id, path) as (
  select node, node, [node] from link where parent is null
  union all select l.node, w.root_id, list_append(w.path, l.node) from trail w join link l on l.parent = w.node)"""


@registry.add(
    "p4_paths",
    f"""with recursive {CHAIN_SQL} {WALK_SQL}, {PATHS_SQL}
select t.node message_id, l.parent, t.root_id, cast(len(t.path) - 1 as int) depth, t.path path from trail t join link l on l.node = t.node
union all select r.node, l.parent, r.root_id, cast(-1 as int), null from ring r join link l on l.node = r.node""",
)
def p4_paths(t: Tables) -> DataFrame:
    solved = hierarchy.resolve(cut(hierarchy.parent_links(t.emails)), paths=True)
    return solved.select(F.col("node").alias("message_id"), "parent", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path")


@registry.add(
    "p4_descendants",
    f"""with recursive {CHAIN_SQL} {PATHS_SQL}
select x.ancestor, x.node, cast(x.depth - x.pos as bigint) distance from (
  select node, len(path) depth, unnest(path) ancestor, generate_subscripts(path, 1) pos from trail) x where x.pos < x.depth""",
)
def p4_descendants(t: Tables) -> DataFrame:
    solved = hierarchy.resolve(cut(hierarchy.parent_links(t.emails)), paths=True)
    return hierarchy.descendants(solved)


@registry.add(
    "p4_descendant_counts",
    f"""with recursive {CHAIN_SQL} {PATHS_SQL}
select ancestor message_id, count(*) n, cast(max(depth - pos) as int) deepest from (
  select node, len(path) depth, unnest(path) ancestor, generate_subscripts(path, 1) pos from trail) where pos < depth group by 1""",
)
def p4_descendant_counts(t: Tables) -> DataFrame:
    solved = hierarchy.resolve(cut(hierarchy.parent_links(t.emails)), paths=True)
    return hierarchy.descendants(solved).groupBy(F.col("ancestor").alias("message_id")).agg(F.count("*").alias("n"), F.max("distance").cast("int").alias("deepest"))

"""The queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import answers, encoding, mixing, names, quotes, spam, tokens
from threadloom.plans.registry import Registry, Tables

registry = Registry()


@registry.add("p8_ids")
def p8_ids(t: Tables) -> DataFrame:
    return tokens.encode(t.documents)


@registry.add("p9_mixture")
def p9_mixture(t: Tables) -> DataFrame:
    return mixing.mix(t.documents, t.mix_targets)[0]


@registry.add("p9_shares")
def p9_shares(t: Tables) -> DataFrame:
    return mixing.mix(t.documents, t.mix_targets)[1]


@registry.add("p6_found")
def p6_found(t: Tables) -> DataFrame:
    return encoding.find(t.emails, ["body", "from_name", "subject"]).select("id", "field")


@registry.add("p6_restored")
def p6_restored(t: Tables) -> DataFrame:
    return encoding.find(t.emails, ["body", "from_name", "subject"]).select("id", "field", "restored", "pairs")


@registry.add("p3_found")
def p3_found(t: Tables) -> DataFrame:
    return names.pairs(names.link(t.emails))


@registry.add("p3_senders")
def p3_senders(t: Tables) -> DataFrame:
    return names.link(t.emails).groupBy("entity").agg(F.count("*").alias("spellings"), F.min("sender").alias("first_spelling"))


@registry.add("p3_members")
def p3_members(t: Tables) -> DataFrame:
    return names.link(t.emails)


@registry.add("p10_found")
def p10_found(t: Tables) -> DataFrame:
    return spam.judge(t.documents).where("share > 0.5").select("doc_id")


@registry.add("p10_shares")
def p10_shares(t: Tables) -> DataFrame:
    return spam.judge(t.documents).select("doc_id", "chars", "bad_chars", F.round("share", 6).alias("share"))


@registry.add("p7_found")
def p7_found(t: Tables) -> DataFrame:
    return answers.judge(t.translation_cache, t.paragraphs, t.threads, t.emails)


@registry.add("p5_found")
def p5_found(t: Tables) -> DataFrame:
    return quotes.not_new(t.emails)


@registry.add("p5_rules")
def p5_rules(t: Tables) -> DataFrame:
    ways = quotes.by_rule(t.emails).groupBy("id", "line_no").agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("rules"))
    return ways.groupBy("rules").agg(F.count("*").alias("lines"))

"""Expressions over mail fields; each builds one Column and stays inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.tables import clean

DROP, LOW, MEDIUM, HIGH = 0, 1, 2, 3
# Character budgets of the priorities, and the labels they are shown under.
BUDGETS = {DROP: 0, LOW: 500, MEDIUM: 2000, HIGH: 5000}
TAGS = {HIGH: "[讨论]", MEDIUM: "[概述/数据]", LOW: "[PATCH摘要]"}
TRIM_ORDER = {"[PATCH摘要]": 1, "[概述/数据]": 2, "[讨论]": 3}
# Words that show performance data, and subjects that are never collected.
PERFORMANCE = ["benchmark", "regression", "perf stat", "hackbench", "specrate", "spec cpu", "throughput", "latency", "improvement", "schedstat"]
UNWANTED_SUBJECTS = [r"\[GIT PULL\]", r"GIT PULL", r"\d+\.\d+\.\d+-stable review", r"\[PATCH \d+\.\d+ ", "AUTOSEL", r"\[PULL\]", "linux-next:", "mmotm ", "active bugs in .* merge window"]
# Names of lists.
LIST_NAMES = {"all": "all", "lkml": "all", "linux-kernel": "all", "linux-mm": "linux-mm", "linux-sched": "linux-kernel", "linux-fsdevel": "linux-fsdevel", "netdev": "netdev", "linux-block": "linux-block", "stable": "stable"}
# Path prefixes of subsystems, in the order they are tried.
SUBSYSTEMS = {"kernel/sched": "sched", "mm/": "mm", "fs/": "fs", "net/": "netdev", "drivers/": "drivers", "arch/": "arch", "security/": "security", "include/linux": "kernel", "block/": "block", "crypto/": "crypto"}
# Words of licence texts.
LICENCE_WORDS = ["license", "licence", "copyright", "warranty", "redistribute", "free software foundation", "general public license", "permission is hereby granted", "as-is", "without warranty", "merchantability", "spdx-license-identifier"]
# Patterns of code references.
DIFF_PATHS = r"diff --git a/([\w/._-]+) b/([\w/._-]+)"
PATCH_PATHS = r"(?m)^(?:---|\+\+\+) [ab]/([\w/._-]+\.\w+)"
HUNK_CONTEXT = r"(?m)^@@[^@]+@@\s+(.+)$"
TREE_PATHS = r"(?<!\w)((?:kernel|drivers|include|mm|fs|net|arch|block|crypto|lib|security|sound|tools|scripts|init|ipc)/[\w/._-]+\.[chS])(?!\w)"
# Subject and reply patterns.
REPLY_PREFIX = r"(?i)^(?:Re:\s*)+"
PATCH_NUMBER = r"\[(?:RFC\]\[)?PATCH(?:\s+v\d+)?\s+(\d+)/(\d+)\]"
PATCH_TAG = r"(?i)\[PATCH(?:\s+(v\d+))?(?:\s+\d+/\d+)*\s*(\d+)/(\d+)\]"
REPLY_LINE = r"(?m)^On .+?,\s*(.+?)\s+wrote:\s*$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_word(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words, as substrings in lower case. False where there are none."""
    return reduce(or_, [F.contains(text, F.lit(w.lower())) for w in words], F.lit(False))


def contained_id(c: Column) -> Column:
    """An id with missing brackets added; '' for null and blank."""
    t = clean(_text(c))
    return F.when(t == "", "").otherwise(F.concat(F.when(t.startswith("<"), "").otherwise("<"), t, F.when(t.endswith(">"), "").otherwise(">")))


def stored_name(sender: Column) -> Column:
    """The part of a From text before its address, as the store keeps it (may be blank)."""
    return clean(F.split_part(sender, F.lit("<"), F.lit(1)))


def shown_name(sender: Column) -> Column:
    """The stored name, else the whole text."""
    return F.when(stored_name(sender) != "", stored_name(sender)).otherwise(sender)


def priority_of(sender: Column, subject: Column, body: Column) -> Column:
    """The value class of a mail: the first rule that holds decides."""
    who, text = F.lower(_text(sender)), _text(body)
    low = F.lower(text)
    title = _text(subject)
    robot = F.contains(who, F.lit("kernel test robot")) | F.contains(who, F.lit("lkp@intel"))
    warns = F.contains(low, F.lit("warning:")) | F.contains(low, F.lit("error:"))
    patch = title.rlike(r"(?i)\[(?:RFC\s*)?(?:PATCH|RESEND)")
    diff = F.contains(text, F.lit("diff --git")) | F.contains(text, F.lit("\n--- a/"))
    return (
        F.when(F.contains(who, F.lit("tip-bot")), DROP)
        .when(robot & warns, LOW)
        .when(robot, DROP)
        .when(title.rlike(r"(?i)\[.*PATCH.*\s+0+/\d+\]"), MEDIUM)
        .when(patch & diff, LOW)
        .when(any_word(F.lower(F.substring(text, 1, 3000)), PERFORMANCE), MEDIUM)
        .otherwise(HIGH)
    )


def budget_of(priority: Column) -> Column:
    return reduce(lambda c, kv: c.when(priority == kv[0], kv[1]), BUDGETS.items(), F.when(F.lit(False), 0))


def tag_of_priority(priority: Column) -> Column:
    return reduce(lambda c, kv: c.when(priority == kv[0], kv[1]), TAGS.items(), F.when(F.lit(False), "")).otherwise("")


def tag_of_row(priority: Column, subject: Column) -> Column:
    """The label of a stored mail, from its priority text and subject."""
    p = F.upper(_text(priority))
    patch = F.contains(p, F.lit("LOW")) | F.contains(F.upper(_text(subject)), F.lit("PATCH"))
    return F.when(F.contains(p, F.lit("HIGH")), TAGS[HIGH]).when(patch, TAGS[LOW]).otherwise(TAGS[MEDIUM])


def trim_order(tag: Column) -> Column:
    return reduce(lambda c, kv: c.when(tag == kv[0], kv[1]), TRIM_ORDER.items(), F.when(F.lit(False), 0)).otherwise(3)


def without_signature(body: Column) -> Column:
    """The body before its first standard signature mark, without white space at its end."""
    head = F.split_part(body, F.lit("\n-- \n"), F.lit(1))
    return F.regexp_replace(head, r"\s+\z", "")


def paragraphs(body: Column) -> Column:
    return F.filter(F.split(clean(_text(body)), r"\n\n+"), lambda p: clean(p) != "")


def base_subject(subject: Column) -> Column:
    return clean(F.regexp_replace(_text(subject), REPLY_PREFIX, ""))


def group_subject(subject: Column) -> Column:
    """The base subject cut to 60 characters, at a blank if one lies beyond the fortieth."""
    base = base_subject(subject)
    head = F.substring(base, 1, 60)
    blank = F.lit(60) - F.instr(F.reverse(head), " ")
    at_blank = (F.instr(F.reverse(head), " ") > 0) & (blank > 40)
    return F.when(F.length(base) <= 60, base).when(at_blank, F.substring(head, F.lit(1), blank)).otherwise(head)


def reply_depth(subject: Column) -> Column:
    return F.regexp_count(_text(subject), F.lit("(?i)Re:"))


def patch_sort_key(subject: Column) -> Column:
    number = F.regexp_extract(_text(subject), PATCH_NUMBER, 1).try_cast("int")
    return F.struct(F.when(number.isNotNull(), 0).otherwise(1).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"))


def patch_tag(subject: Column) -> Column:
    """struct(number, total, version, cover) of a [PATCH vN n/m] tag; zeros and false without one."""
    part = lambda k: F.regexp_extract(_text(subject), PATCH_TAG, k)
    number = part(2).try_cast("int")
    return F.struct(
        F.coalesce(number, F.lit(0)).alias("number"), F.coalesce(part(3).try_cast("int"), F.lit(0)).alias("total"), part(1).alias("version"), F.coalesce(number == 0, F.lit(False)).alias("cover")
    )


def reply_target(body: Column) -> Column:
    """Whom the first reply line names: the address if it has one, else the name; lower case, '' without such a line."""
    who = clean(F.regexp_extract(_text(body), REPLY_LINE, 1))
    address = F.regexp_extract(who, "<([^>]+)>", 1)
    return F.lower(F.when(address != "", address).otherwise(who))


# Fixed value: a link into the list archive.
ARCHIVE_LINK = r"https://lore\.kernel\.org/\S+"


def archive_link(body: Column) -> Column:
    """The first link into the list archive, without punctuation after it; links to other hosts don't count."""
    return F.regexp_replace(F.regexp_extract(_text(body), ARCHIVE_LINK, 0), r"[)>.,]+\z", "")


def code_files(body: Column) -> Column:
    """Sorted distinct paths of C and assembler files that diffs, patch headers and prose name."""
    b = _text(body)
    found = F.array_union(F.array_union(F.regexp_extract_all(b, F.lit(DIFF_PATHS), F.lit(2)), F.regexp_extract_all(b, F.lit(PATCH_PATHS), F.lit(1))), F.regexp_extract_all(b, F.lit(TREE_PATHS), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: p.rlike(r"\.[chS]\z"))))


def code_functions(body: Column) -> Column:
    found = F.transform(F.regexp_extract_all(_text(body), F.lit(HUNK_CONTEXT), F.lit(1)), clean)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def is_patch(subject: Column, body: Column) -> Column:
    return _text(body).rlike(DIFF_PATHS) | F.contains(_text(subject), F.lit("[PATCH"))


def subsystem_of(path: Column) -> Column:
    return reduce(lambda c, kv: c.when(path.startswith(kv[0]), kv[1]), SUBSYSTEMS.items(), F.when(F.lit(False), ""))


def subsystems(files: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(files, subsystem_of), lambda x: x.isNotNull())))


def is_licence(text: Column) -> Column:
    low = F.lower(_text(text))
    return reduce(lambda a, w: a + F.contains(low, F.lit(w)).cast("int"), LICENCE_WORDS, F.lit(0)) >= 2


def unwanted_subject(subject: Column, more: list[str] | None = None) -> Column:
    patterns = [*UNWANTED_SUBJECTS, *(more or [])]
    return _text(subject).rlike("(?i)" + "|".join(patterns))


def wanted(subject: Column, body: Column, keywords: list[str], unwanted: list[str] | None = None, subsystem: list[str] | None = None, topic: list[str] | None = None) -> Column:
    """The rule filter: no unwanted subject, and both layers hit if both are set, else any keyword."""
    text = F.lower(F.concat(_text(subject), F.lit(" "), F.substring(_text(body), 1, 2000)))
    hit = any_word(text, subsystem) & any_word(text, topic) if subsystem and topic else any_word(text, keywords)
    return ~unwanted_subject(subject, unwanted) & hit


def parse_keywords(expression: str) -> tuple[str, list[str]]:
    """('and'|'or'|'plain', terms): AND goes before OR, both are recognised in upper case and split in any case."""
    import re

    text = expression.strip()
    for word in ("AND", "OR"):
        if re.search(rf"\b{word}\b", text):
            return word.lower(), [t.strip().lower() for t in re.split(rf"\b{word}\b", text, flags=re.I) if t.strip()]
    return "plain", [text.lower()]


def matches_keywords(text: Column, expression: str) -> Column:
    kind, terms = parse_keywords(expression)
    hits = [F.contains(F.lower(_text(text)), F.lit(t)) for t in terms]
    return reduce(and_ if kind == "and" else or_, hits, F.lit(True) if kind == "and" and not hits else hits[0] if hits else F.lit(False))


def list_name(alias: Column) -> Column:
    return reduce(lambda c, kv: c.when(alias == kv[0], kv[1]), LIST_NAMES.items(), F.when(F.lit(False), "")).otherwise(alias)


def json_list(text: Column) -> Column:
    """A JSON list field as an array; other JSON and plain text as one element; blank as none."""
    parsed = F.from_json(text, "array<string>")
    scalar = F.get_json_object(text, "$")
    return F.when(_text(text) == "", F.array().cast("array<string>")).when(clean(text).startswith("["), F.coalesce(parsed, F.array(text))).otherwise(F.array(F.coalesce(F.when(clean(text).startswith('"'), scalar), text)))


def escape_html(text: Column, quotes: bool = False) -> Column:
    out = _text(text)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&#x27;")] if quotes else [])]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_name(text: Column, style: str = "thread") -> Column:
    """A text as file name, in one of three styles: `thread`, `web` or `mail`."""
    pattern, size = {"thread": (r"[^a-zA-Z0-9_\-]", 80), "web": (r'[<>:"/\\|?*\s]', 120), "mail": (r"[<>@/\\]", 80)}[style]
    return F.substring(F.regexp_replace(text, pattern, "_"), 1, size)


def cache_key(backend: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", backend, text), 256)


def source_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def answer_parts(answer: Column) -> Column:
    """struct(subject, body) of an answer that was asked for both: its first line and the rest ('' without one)."""
    text = clean(_text(answer))
    lines = F.split(text, "\n", 2)
    return F.struct(F.get(lines, 0).alias("subject"), F.coalesce(F.get(lines, 1), F.lit("")).alias("body"))


def is_html_error(content: Column) -> Column:
    # What the start of an error page has.
    head = F.lower(F.substring(content, 1, 500))
    return any_word(head, ["<!doctype html", "<html", "<head>", "<body"])


def thread_link(url: Column) -> Column:
    """struct(message_id, list) of an archive link, /r/<id> or /<list>/<id>."""
    short, long = F.regexp_extract(url, r"/r/([^/?#]+)", 1), r"https?://[^/]+/([^/]+)/([^/?#]+@[^/?#]+)"
    return F.struct(F.when(short != "", short).otherwise(F.regexp_extract(url, long, 2)).alias("message_id"), F.when(short != "", "").otherwise(F.regexp_extract(url, long, 1)).alias("list"))


def translation_score(translated: Column, original: Column) -> Column:
    """How likely two paragraphs are a translation pair: length, words and shared tokens; 0 to 1."""
    cs, es = clean(_text(translated)), clean(_text(original))
    squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
    han = F.regexp_count(cs, F.lit(r"[\x{4e00}-\x{9fff}]"))
    cn_size, en_size = F.length(cs) + han, F.length(es)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double")), F.lit(0.0))
    cn_words = han * 0.5 + F.regexp_count(cs, F.lit("[A-Za-z]+"))
    en_words = F.regexp_count(es, F.lit(r"\S+")).cast("double")
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]+|[A-Z]{2,}|[a-z_]{4,}|\d+"), F.lit(0)))
    ct, et = tokens(cs), tokens(es)
    shared = F.size(F.array_intersect(ct, et))
    share = F.coalesce(F.try_divide(shared.cast("double"), F.size(et).cast("double")), F.lit(0.0))
    base = ratio(cn_size, en_size) * 0.3 + ratio(cn_words, en_words) * 0.25
    with_tokens = F.when(F.size(et) == 0, base + 0.05).otherwise(
        (base + F.when(shared >= 2, F.least(share * 0.4 + 0.05, F.lit(0.4))).otherwise(share * 0.35)) * F.when((F.size(et) >= 3) & (shared == 0), 0.4).otherwise(1.0)
    )
    total = F.least(with_tokens + F.when(han > 0, 0.15).otherwise(0.0), F.lit(1.0))
    untranslated = (cs == "") | (es == "") | (squeeze(cs) == squeeze(es)) | shares_lines(cs, es) | (ratio(cn_size, en_size) < 0.15)
    return F.when(untranslated, 0.0).otherwise(total)


def lines_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(_text(text), "\n"), clean), lambda x: x != ""))


def shares_lines(a: Column, b: Column) -> Column:
    """Whether a has at least 80 % of the distinct lines of b."""
    la, lb = lines_of(a), lines_of(b)
    return (F.size(la) > 0) & (F.size(lb) > 0) & (F.size(F.array_intersect(la, lb)) >= F.size(lb) * 0.8)

"""Each mail reduced to the text its sender newly wrote.

Bodies become normalised lines, without quotation marks. Within a thread the mail that had a line first, by date, is its
author; later occurrences are not new: marked ones at once, unmarked ones where two neighbouring lines show a quotation,
and words spilled over from a quoted line. The closing lines of mails that recur over a sender's mails are taken off from
the end inwards, with SQL windows. `by_rule` tells which lines each way finds.
Text of mails that the thread doesn't hold, and what belongs to no earlier mail, shows by its form, line by line: quotation marks, lines that introduce quotations, copied
headers and all below them, signature blocks, farewells, notices, list and client footers, version lines of patches.

Only hashes of lines are shuffled. First authors are a minimum by thread and line, taken before the shuffle, so that a
thread or a line of a third of all mails is one row per task; the windows run within one mail.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.encoding import PAIRS
from threadloom.operators import timestamps
from threadloom.tables import cut, one_form


def _looks(chars: Iterable[str]) -> set[str]:
    """What characters or phrases look like when read in a wrong character set."""
    out = set()
    for c in chars:
        for true, wrong in PAIRS:
            try:
                for now in (c, c.encode("utf-8").decode("cp1252", "replace")):
                    seen = now.encode(true).decode(wrong, "replace")
                    if not seen.isascii() and seen.strip():
                        out.add(seen.strip("�") or seen)
            except UnicodeError:
                continue
    return out - {"�"}


def _either(texts: set[str]) -> str:
    return "|".join(sorted(map(re.escape, texts), key=lambda x: -len(x)))


# Words of mail programs and of mailing lists.
MARK = re.compile(rf"^(?:\s{{0,4}}(?:[>»＞]|[|:](?=[\s>|:»]|$)|[A-ZÀ-ÖØ-ÞŁŚŠŽĆČŽ]{{1,3}}>|�(?= )|(?:{_either(_looks("»＞"))})�*))+ ?")
VERB = r"(?:wrote|writes|said|says|schrieb|geschrieben|écrit|escribió|ha scritto|skrev|schreef|napisał\w*|写道|写|написал\w*|пишет|書きました|さんの発言)"
INTRODUCES = re.compile(rf"(?:{VERB}\s*(?:[:：]|$)|^(?:Quoting|\*)\s.*[)\]]\s*:)\s*$", re.I)
BEGINS = re.compile(r"^\s*(?:On|Am|Le|El|In message|In article|Quoting|\*|W dniu|Il|Op|Den|在|于|пользователь|\d{4}年|\d{1,4}[./-]\d{1,2}[./-])\b|^\s*[在于]|^<[^>]*>\s|^\S+@\S+")
DATED = re.compile(r"\d{1,2}:\d{2}|\d{8}T\d{4}|\d{4}[-/年]|\b\d{10,16}\b|\b(?:19|20)\d\d\b|\byesterday\b|\bunknown\b")
HEADER = re.compile(
    r"^\s*\**(From|Sent|Date|To|Cc|Subject|Reply-To|发件人|发送时间|日期|收件人|抄送|主题|Von|Gesendet|Datum|An|Betreff|De|Envoyé|Date|À|Objet|От|Отправлено|Дата|Кому|Тема|差出人|送信日時|日時|宛先|件名)\**\s?[:：]\s?", re.I
)
WHO = {"from", "发件人", "von", "de", "от", "差出人"}
DIVIDER = re.compile(r"^\s*(?:-{2,}\s*(?:Original Message|Forwarded [Mm]essage|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Message d'origine|Message transféré|原始邮件|转发邮件|Исходное сообщение|元のメッセージ)\s*-{2,}|Begin forwarded message:|_{20,})\s*$", re.I)
RULE = re.compile(rf"^(?:-- ?|—|–|�|(?:{_either(_looks('—'))})�*|_{{6,}}|={{6,}}|\*(?: \*){{2,}}|~{{4,}}|-{{6,}}|-{{2,}} ?8< ?-{{2,}})\s*$")
FAREWELL = re.compile(
    r"(?i)^(?:best|best wishes|(?:best|kind|warm)(?:est)? regards|regards|cheers|many thanks|thanks|thank you|thx|br|rgds|sincerely|yours|greetings|ciao|viele grüße|(?:mit )?freundliche\w* grü(?:ße|ßen)|grüße|gruß|lg|mfg|vg|cordialement|bien à vous|bonne journée|à bientôt|merci|amicalement|saludos|с уважением|спасибо|всего доброго|此致|敬礼|谢谢|祝好|致敬|顺祝商祺|敬具|よろしくお願いします|以上)[,，.!。]?\s*$"
)
NOTICE = re.compile(r"(?i)^\s*(?:NOTICE:|CONFIDENTIAL|DISCLAIMER|The contents of this (?:message|e-?mail)|.{2,40} is a trading name|This (?:e-?mail|message|communication|transmission)\b.{0,60}(?:confidential|privileged|intended)|Diese (?:E-Mail|Nachricht)|Ce (?:message|courriel)|本邮件)")
FOOTER = re.compile(r"(?i)^\s*(?:Sent from (?:my|a)\b|Sent (?:with|via|using)\b|Get \w+ for\b|Von unterwegs gesendet|Gesendet (?:von|mit)\b|Envoyé (?:de|depuis)\b|发自|来自我的|Отправлено с|iPhoneから送信|To unsubscribe\b|Unsubscribe:|\S.{0,60}\bmailing list\b\s*(?:--|:|$))")
#: Closings whose words have a damage of their own.
GARBLED = re.compile(rf"^\s*(?:{_either({x for x in _looks(['发自我的手机', '此致', '祝好', '本邮件及其附件', 'Mit freundlichen Grüßen', 'Viele Grüße']) if len(x) > 2})})")
CODE = re.compile(r"^\s*(?:[+\-@#\[{}|]|diff |index [0-9a-f]|CONFIG_|\w[\w-]*-by:|Cc:|Fixes:|Link:|Result:|run \d)|[;{}]\s*$|\s\|\s+\d+ [+-]")
TITLE = re.compile(r"\b(?:Engineer|Architect|Reliability|Developer|Manager|Director|Maintainer|team at|group|Street|Road|ext\.|desk|building)\b|^https?://\S+/people/|^[\"“].*[\"”]$|^\S+@\S+ \|")


#: How a quotation mark may begin, so that most lines need no pattern.
_FIRST = frozenset(x[0] for x in _looks("»＞")) | {"�"}
_RULED = frozenset(x[0] for x in _looks("—"))
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŁŚŠŽĆČ")


def is_marked(line: str) -> bool:
    """Whether a line begins with a quotation mark."""
    text = line.lstrip()
    if not text or len(line) - len(text) > 4:
        return False
    c = text[0]
    if c in ">»＞":
        return True
    if c in "|:":
        return bool(MARK.match(line)) and not (c == "|" and text.rstrip().endswith("|") and text.count("|") > 2)
    return (c in _UPPER and ">" in text[1:4] or c in _FIRST) and bool(MARK.match(line))


def flat(line: str) -> str:
    """A line in lower case without white space."""
    return "".join(line.lower().split())


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _fold(text: str) -> set[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ø", "o").replace("ł", "l").replace("Ł", "L").replace("Ø", "O")) if not unicodedata.combining(c))
    return {w for w in re.findall(r"[^\W\d_]+", plain.lower()) if len(w) > 1}


#: What a line is: long enough to show an unmarked quotation, code, old by its form, marked or below a copied header.
TELLS, IS_CODE, IS_OLD, IS_SHOWN = 1, 2, 4, 8
#: How a line is looked for in earlier mail: as a marked one, as the sender's own, as words spilled over.
MARKED, OWN, SPILL = 0, 1, 2


def shape(body: str, sender: str) -> tuple[list[int], list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """(old, said, spilled) of one body.

    old: numbers of the lines that by their form are not newly written. said: all lines that aren't blank, as (number, place
    among the lines that aren't blank, hash without marks, kind); kind is a sum of TELLS, IS_CODE, IS_OLD and IS_SHOWN. spilled: unmarked lines just below a marked one, as (number, hash of both together).
    """
    lines = [x.rstrip("\r") for x in body.split("\n")]
    n = len(lines)
    full = [bool(x) and not x.isspace() for x in lines]
    marked = [f and is_marked(x) for x, f in zip(lines, full, strict=True)]
    if sum(marked) < 2:  # one line that begins with a colon or bar is not a quotation, unless it is introduced
        marked = [m and (x.lstrip()[:1] in ">»＞" or bool(INTRODUCES.search(next((lines[j] for j in (k - 1, k - 2) if j >= 0 and full[j]), "")))) for k, (m, x) in enumerate(zip(marked, lines, strict=True))]
    after = [n] * (n + 1)  # the next line that isn't blank
    for k in range(n - 1, -1, -1):
        after[k] = k if full[k] else after[k + 1]
    old = set(k for k in range(n) if marked[k])
    shown, _, address = sender.rpartition("<")
    local = address.split("@")[0]
    names = _fold(shown) | (set() if any(map(str.isdigit, local)) else _fold(local))
    end = n
    # a copied header and all below it
    k = 0
    while k < n:
        if marked[k] or not full[k]:
            pass
        elif (":" in lines[k][:20] or "：" in lines[k][:20]) and HEADER.match(lines[k]):
            j, found = k, []
            while j < n and full[j] and (h := HEADER.match(lines[j])):
                found.append(h.group(1).lower())
                j += 1
            if len(found) >= 2 and WHO & set(found) and not (set(found) <= {"from", "to", "cc"}):
                top = k
                for back in range(k - 1, max(-1, k - 3), -1):
                    if DIVIDER.match(lines[back]):
                        top = back
                        break
                    if full[back]:
                        break
                end = top
                break
            k = j
        elif lines[k].lstrip()[0] in "-B" and DIVIDER.match(lines[k]):
            end = k
            break
        k += 1
    old |= set(range(end, n))
    # lines that introduce a quotation
    for k in range(end):
        if not full[k] or marked[k]:
            continue
        nxt = after[k + 1] if k + 1 <= n else n
        leads = nxt < n and (marked[nxt] or nxt >= end)
        text = lines[k].rstrip()
        if not leads and text[-1] not in ":：":
            continue
        if INTRODUCES.search(text) and (leads or DATED.search(text) or "@" in text) or (leads and text.endswith((":", "：")) and (DATED.search(text) or "@" in text) and len(text) < 200):
            old.add(k)
            for back in range(k - 1, max(-1, k - 3), -1):
                if not full[back] or marked[back]:
                    break
                if (BEGINS.match(lines[back]) or re.search(r"<?\S+@\S+>?\s*$", lines[back])) and len(lines[back]) < 160 and (DATED.search(lines[back]) or "@" in lines[back] or "<" in lines[back]):
                    old |= set(range(back, k))
                    break
    # the closing: from the first line that begins a signature, farewell, notice or footer
    def closes(k: int) -> bool:
        text = lines[k]
        if NOTICE.match(text) or FOOTER.match(text) or (not text.isascii() and GARBLED.match(text)):
            return True
        first = text.lstrip()[0]
        if (not first.isalnum() or first in _RULED) and RULE.match(text):
            nxt = after[k + 1]
            rest = sum(1 for j in range(k + 1, end) if full[j] and not marked[j])
            if text.rstrip() == "--" or text.startswith("-- "):
                return True
            if nxt >= end or len(lines[nxt]) > 60 or rest > 16 or (first == "-" and any(map(str.isdigit, lines[nxt]))):
                return False  # also the rule of a table
            below = lines[after[nxt + 1]] if after[nxt + 1] < end else ""
            if _fold(lines[nxt]) & names or TITLE.search(below) or FOOTER.match(lines[nxt]) or NOTICE.match(lines[nxt]):
                return True
            return text.startswith(("—", "=", "_", "~", "*")) and len(lines[nxt].split()) <= 4 and rest <= 12
        if len(text) < 40 and (not k or not full[k - 1] or marked[k - 1]) and FAREWELL.match(text):
            nxt = after[k + 1]
            if nxt >= end:
                return True
            rest = sum(1 for j in range(k + 1, end) if full[j] and not marked[j])
            return len(lines[nxt].split()) <= 5 and (bool(_fold(lines[nxt]) & names) or rest <= 5 or not lines[nxt].rstrip().endswith((".", ":", "?")))
        # a paragraph that begins with a name alone: the sender's, or any above a line of a post or place
        if (k and full[k - 1]) or len(text) > 60 or len(text.split()) > 4 or re.search(r"[.,:;?!()\d]", text) or CODE.match(text):
            return False
        below = lines[k + 1] if k + 1 < end and full[k + 1] else ""
        return bool(_fold(text) & names) or bool(TITLE.search(below) and text[:1].isupper() and len(below) < 70)

    for k in range(end):
        if full[k] and not marked[k] and k not in old and closes(k):
            first = k - 1 if k and full[k - 1] and not marked[k - 1] and RULE.match(lines[k - 1]) else k
            old |= set(range(first, end))
            break
    spilled = []
    for k in range(1, end):
        if full[k] and not marked[k] and k not in old and marked[k - 1]:
            above = MARK.sub("", lines[k - 1])
            if k + 1 < n and marked[k + 1] and len(lines[k]) < 45 and len(above) >= 35:
                old.add(k)  # a short line between two marked ones is the end of the line above
            else:
                spilled.append((k + 1, digest(flat(above) + flat(lines[k]))))
    said, place = [], 0
    for k in range(n):
        place += full[k]
        if full[k]:
            shown = marked[k] or k >= end
            text = flat(MARK.sub("", lines[k]) if marked[k] else lines[k])
            if not text:
                continue  # a mark alone
            said.append((k + 1, place, digest(text), TELLS * (len(text) >= TELLING) | IS_CODE * bool(CODE.search(lines[k])) | IS_OLD * (k in old) | IS_SHOWN * shown))
    return sorted(k + 1 for k in old if full[k]), said, spilled


#: Lines shorter than this (letters and digits) can't show an unmarked quotation by themselves.
TELLING = 28
#: In how many of a sender's mails, and in which share of them, a closing line must stand.
OFTEN, SHARE = 3, 0.2


def lines_of(emails: DataFrame) -> DataFrame:
    """One row for each mail with a body: id, thread, message, sender, answer, at, old, and said (no, place, h, kind) and
    spilled as one array a field, which take half the room of structs.

    Links may be blank, so each mail that names another one or isn't the one its thread is named after is an answer.
    """
    linked = (F.trim(F.coalesce("in_reply_to", F.lit(""))) != "") | (F.trim(F.coalesce("refs", F.lit(""))) != "") | F.coalesce(one_form("message_id") != one_form("thread_id"), F.lit(True))
    mails = emails.where("body is not null").withColumn("sender", F.coalesce(F.col("from_email"), F.col("from_name"), F.lit("")))
    mails = timestamps.normalise(mails.select("id", "sender", "body", "date", one_form("thread_id").alias("thread"), F.when(one_form("message_id").isNotNull(), F.xxhash64(one_form("message_id"))).alias("message"), linked.alias("answer"), "created_at"), "date", F.lit("emails.date"))
    mails = mails.select("id", "sender", "body", "thread", "message", "answer", F.coalesce("utc_us", (F.col("created_at") * 1_000_000).cast("bigint"), F.lit(0)).alias("at"))
    schema = "id bigint, thread bigint, message bigint, sender bigint, answer boolean, at bigint, old array<int>, no array<int>, place array<int>, h array<bigint>, kind array<tinyint>, spilled_no array<int>, spilled_h array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("id", "message", "answer", "at")}
            shapes = [shape(b, s) for b, s in zip(col["body"], col["sender"], strict=True)]
            flatten = lambda k: [x for s in shapes for x in s[k]]
            starts = lambda k: pa.array([0, *accumulate(len(s[k]) for s in shapes)], pa.int32())
            said, spilled = flatten(1), flatten(2)
            lists = lambda k, rows, kinds: [pa.ListArray.from_arrays(starts(k), pa.array([x[n] for x in rows], kind)) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([None if t is None else digest(t) for t in col["thread"]], pa.int64()),
                    batch.column("message"),
                    pa.array([digest(s) for s in col["sender"]], pa.int64()),
                    batch.column("answer"),
                    batch.column("at"),
                    pa.ListArray.from_arrays(starts(0), pa.array(flatten(0), pa.int32())),
                    *lists(1, said, (pa.int32(), pa.int32(), pa.int64(), pa.int8())),
                    *lists(2, spilled, (pa.int32(), pa.int64())),
                ],
                names=["id", "thread", "message", "sender", "answer", "at", "old", "no", "place", "h", "kind", "spilled_no", "spilled_h"],
            )

    return mails.mapInArrow(run, schema)


def said(mails: DataFrame, *keys: str) -> DataFrame:
    """The lines of said, one a row: keys, line_no, place, h, kind."""
    lines = mails.select(*keys, F.inline(F.arrays_zip("no", "place", "h", "kind")))
    return lines.withColumnRenamed("no", "line_no")


def is_(kinds: int) -> Column:
    """Whether a line is of any of the kinds."""
    return F.col("kind").bitwiseAND(F.lit(kinds).cast("tinyint")) != 0


def quoted_runs(inside: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, line_no): the seeds of unmarked quotations with the lines beside them, also short ones, code and lines across
    blank ones, that stand in the earlier mail too.

    seeds(thread, id, line_no, first_at) names that mail by its time. Only mails with seeds and the mails they quote are
    joined, and a run is made within one mail.
    """
    quoted = seeds.select("thread", "id", "first_at").distinct()
    earlier = inside.withColumnRenamed("at", "first_at").drop("id").join(quoted, ["thread", "first_at"])
    earlier = said(earlier, "id").where(~is_(IS_SHOWN)).select("id", "h").distinct()
    lines = said(inside.join(seeds.select("id").distinct(), "id", "left_semi"), "id").where(~is_(IS_OLD)).drop("kind")
    also = lines.join(earlier, ["id", "h"], "left_semi").join(seeds.select("id", "line_no", F.lit(True).alias("seed")), ["id", "line_no"], "left")
    run = also.withColumn("run", F.col("place") - F.row_number().over(W.partitionBy("id").orderBy("place")))
    return run.withColumn("found", F.max("seed").over(W.partitionBy("id", "run"))).where("found").select("id", "line_no")


def by_rule(emails: DataFrame) -> DataFrame:
    """(id, line_no, rule): the lines that each way finds: `author` (an earlier mail of the thread had them), `closing` (they
    recur at the end of the sender's mails) and `form`. A line may come by several."""
    shaped = cut(lines_of(emails))
    formal = shaped.select("id", F.explode("old").alias("line_no"))
    # first authors of the lines of each thread, and for marked lines the first mails that show them; a mail that is quoted
    # before its own date (dates may be wrong) stays the author of its unmarked lines
    inside = shaped.where("thread is not null")
    firsts = said(inside, "thread", "at").groupBy("thread", "h").agg(F.min(F.when(~is_(IS_SHOWN), F.col("at"))).alias("first_at"), F.min("at").alias("first_shown"))
    shown = is_(IS_SHOWN)
    tells = F.col("answer") & is_(TELLS) & ~is_(IS_CODE | IS_OLD)
    own = said(inside, "thread", "id", "message", "at", "answer").where(shown | tells)
    own = own.select("thread", "id", "message", "at", "line_no", "place", "h", F.when(shown, MARKED).otherwise(OWN).cast("tinyint").alias("way"))
    spilled = inside.select("thread", "id", "message", "at", F.inline(F.arrays_zip("spilled_no", "spilled_h"))).select("thread", "id", "message", "at", F.col("spilled_no").alias("line_no"), F.lit(None).cast("int").alias("place"), F.col("spilled_h").alias("h"), F.lit(SPILL).cast("tinyint").alias("way"))
    seen = own.unionByName(spilled).join(firsts, ["thread", "h"]).where(F.when(F.col("way") == MARKED, F.col("first_shown")).otherwise(F.col("first_at")) < F.col("at"))
    # cut once, and not computed again for each of its uses
    seen = cut(seen.select("id", "line_no", "way", *[F.when(F.col("way") != MARKED, F.col(x)).alias(x) for x in ("thread", "message", "place", "first_at")]))
    marked = seen.where(F.col("way") == MARKED).select("id", "line_no")
    # a mail stored again with another date doesn't quote itself
    copies = inside.where("message is not null").select("thread", "message", F.col("at").alias("first_at"))
    # one such line may be chance; two neighbouring ones are a quotation (of one mail, if blank lines part them), and so
    # is a spilled-over line
    seen = cut(seen.where(F.col("way") != MARKED).join(copies, ["thread", "message", "first_at"], "left_anti").select("thread", "id", "line_no", "place", "first_at", (F.col("way") == SPILL).alias("spill")))
    mail = W.partitionBy("id").orderBy("line_no")
    by = lambda way: (way("line_no").over(mail), way("place").over(mail), way("first_at").over(mail))
    touches = lambda way, step: (by(way)[0] == F.col("line_no") + step) | ((by(way)[1] == F.col("place") + step) & (by(way)[2] == F.col("first_at")))
    seeds = seen.withColumn("run", F.coalesce(touches(F.lag, -1), F.lit(False)) | F.coalesce(touches(F.lead, 1), F.lit(False))).where("run and not spill").select("thread", "id", "line_no", "first_at")
    unmarked = quoted_runs(inside.select("thread", "id", "at", "no", "place", "h", "kind"), cut(seeds)).unionByName(seen.where("spill").select("id", "line_no"))
    # closing lines that recur over a sender's mails, from the end inwards: each line below the last one that neither recurs
    # nor is old by its form (mails of one message don't make a line recur)
    own_kind = lambda x: x["kind"].bitwiseAND(F.lit(IS_CODE | IS_SHOWN).cast("tinyint")) == 0
    fresh = lambda x: x["kind"].bitwiseAND(F.lit(IS_CODE | IS_SHOWN | IS_OLD).cast("tinyint")) == 0
    distinct = F.array_distinct(F.transform(F.filter(F.arrays_zip("h", "kind"), own_kind), lambda x: x["h"]))
    letter = F.coalesce("message", "id")
    mails = shaped.groupBy("sender").agg(F.count("*").alias("mails"))
    often = shaped.select("sender", letter.alias("letter"), F.explode(distinct).alias("h")).groupBy("sender", "h").agg(F.count("*").alias("n"), F.min("letter").alias("one"), F.max("letter").alias("other"))
    often = often.where((F.col("n") >= OFTEN) & (F.col("one") < F.col("other"))).join(mails, "sender").where(F.col("n") >= SHARE * F.col("mails")).select("sender", "h")
    again = said(shaped, "id", "sender").where(~is_(IS_CODE | IS_SHOWN)).select("id", "line_no", "sender", "h").join(often, ["sender", "h"], "left_semi")
    again = again.groupBy("id").agg(F.collect_list("line_no").alias("again"))
    news = F.transform(F.filter(F.arrays_zip("no", "kind"), fresh), lambda x: x["no"])
    ends = shaped.select("id", news.alias("news")).join(again, "id")
    above = F.coalesce(F.array_max(F.array_except("news", "again")), F.lit(0))
    closed = ends.select("id", above.alias("above"), F.explode("again").alias("line_no")).where("line_no > above").select("id", "line_no")
    rules = {"form": formal, "author": marked.unionByName(unmarked), "closing": closed}
    return reduce(DataFrame.unionByName, [df.withColumn("rule", F.lit(name)) for name, df in rules.items()])


def not_new(emails: DataFrame) -> DataFrame:
    """(id, line_no): each line of a body that is not blank and was not newly written by the mail's sender.

    Lines are numbered from 1 after splitting at a newline; a carriage return before it belongs to the break. Null and
    empty bodies have no lines; whole bodies are read, however long. Mails stored twice are judged each by itself: text of
    a mail with the same date or the same message id is not earlier text. Mails without a thread are judged by their form and sender alone.
    An empty table gives no rows.
    """
    return by_rule(emails).select("id", "line_no").distinct()

"""Defective answers of prompt and response pairs.

Copies are found by compression: an answer that its prompt, as a zstandard dictionary, compresses to less than COPIED of
its size was taken from the prompt. Refusals and placeholders come from dictionaries, the language from the scripts of
the words, and cut-off answers from a model of terminal contexts: how often the last sign of an answer ends an answer to
such a prompt and how often it stands inside one, over all answers. An answer that lacks most sentences of its prompt is
cut off too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.tables import cut, one_form

# Placeholders and refusals.
PLACEHOLDERS = {"null", "none", "nil", "na", "nan", "undefined", "todo", "tbd", "empty", "blank", "placeholder", "translation", "无", "空", "暂无", "暂无摘要", "暂无翻译", "无内容", "待翻译", "待补充", "译文", "翻译", "摘要", "省略"}
REFUSAL = re.compile(
    r"(?i)^.{0,12}(?:抱歉|对不起|遗憾|不好意思)[，,！!。 ].{0,16}(?:无法|不能|没有|帮不上|不便|不确定|作为)|^.{0,6}我(?:无法|不能|没有权限|不确定您|帮不上|没办法)|请(?:您)?(?:提供|说明|补充|告诉我|粘贴).{0,12}(?:文本|内容|问题|原文|邮件|信息)|作为.{0,6}(?:语言模型|人工智能|AI)"
    r"|(?:服务|系统|接口).{0,6}(?:不可用|繁忙|超时)|请稍后(?:再试|重试)|超出.{0,4}长度限制|内容策略|被.{0,6}拦截|(?:生成|翻译|请求|处理|调用)(?:失败|出错|超时)\s*[:：，。]|^无法完成\s*[:：]|没有办法给出|请求我帮不上忙|^错误\s*[:：]"
    r"|^.{0,40}\b(?:I|we)(?:'m| am|’m| was)? (?:can't|cannot|can’t|could not|couldn't|won't|won’t|will not|unable|not able|afraid|do not have|don't have|am not sure what|not sure what)\b(?! (?:refuse|decline|reject)).{0,40}\b(?:translat|summari|process|help|produc|complet|assist|provid|access|do|answer|request|permission|understand|follow)"
    r"|something I am not able to|\b(?:must|have to) (?:decline|refuse)|^as an? (?:AI|language)|timed? ?out|rate limit|service (?:is )?(?:temporarily )?unavailable|please (?:provide|paste|clarify|share|tell me|specify)|\bHTTP [45]\d\d|^(?:error|exception|traceback)\b\s*[:：(\[]|exceeds? the (?:maximum|limit|length)|content (?:policy|filter)|quota exceeded"
)
LABEL = re.compile(r"^\s*(?:```\w*\s*)?[“\"「『【(（]?\s*(?:原文|译文|翻译|翻译结果|中文翻译|中文|主题|标题|摘要|总结|source|original|translation|summary|subject|text|answer)\s*[\])）】]?\s*[:：]\s*", re.I)
WORDLESS = re.compile(r"[\W_]+")
HAN, KANA, HANGUL, OTHER = re.compile(r"[㐀-䶿一-鿿]"), re.compile(r"[぀-ヿ]"), re.compile(r"[가-힣]"), re.compile(r"[Ѐ-ӿͰ-Ͽ؀-ۿ]+")
IDENTIFIER = re.compile(r"[A-Za-z0-9]*_[A-Za-z0-9_]*(?:\(\))?|[\w.-]+(?:/[\w.-]+)+|\b[0-9a-f]{7,40}\b|\bv?\d[\w.%]*|“[^”]*(?:”|$)|\"[^\"]*\"|[A-Z][a-z]+(?:-[A-Za-z]+)*-by\b|<[^>]+>")
LATIN = re.compile(r"[^\W\d_㐀-鿿぀-ヿ가-힣]{2,}")
CODE_LINE = re.compile(r"^\s*(?:[+\-@#].*|(?:# )?CONFIG_\w+.*|[A-Z][a-z]+(?:-[A-Za-z]+)*-by:.*|(?:Fixes|Link|Cc|Closes|Cherry-picked|Message-ID|Change-Id):.*|diff --git.*|index [0-9a-f].*|\$ .*|\[\s*\d+\.\d+\].*|.*[;{}]\s*|\w+\s*=\s*\S+|[\w./-]+\(\)|\s*\S+\s+\|\s+\d+ [+-]+)$")
END = re.compile(r"[。！？!?]|\.(?!\w)")
FENCE = re.compile(r"^\s*```\w*\s*\n?|\n?\s*```\s*$")


def norm(text: str) -> str:
    return WORDLESS.sub("", text.lower())


def bare(text: str) -> str:
    """An answer without label, fences and quotes."""
    return LABEL.sub("", FENCE.sub("", text)).strip().strip("“”\"「」")


def is_code(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and all(CODE_LINE.match(x) for x in lines)


def left_over(answer: str, prompt: str) -> float:
    """The compressed size of an answer, with its prompt as dictionary, over its size."""
    import zstandard

    data, seen = answer.encode(), prompt.encode()
    if not data:
        return 1.0
    if len(seen) < 8:
        return 0.0 if data == seen else 1.0
    made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(seen, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    return max(0, len(made.compress(data)) - 12) / len(data)


QUOTED = re.compile(r"“[^”]*(?:”|$)")
#: Answers with less than this left over are copies; beyond EXACT characters, below which the frame of the compressed form
#: weighs more than the text and texts are compared exactly.
COPIED, EXACT = 0.3, 16


def copies(answer: str, prompt: str) -> bool:
    """Whether an answer gives back (part of) its prompt, by its compressed size. What Chinese text quotes it doesn't give
    back."""
    outside = QUOTED.sub(" ", text := bare(answer))
    a, p = norm(outside if HAN.search(outside) else text), norm(prompt)
    if len(a) < 4 or not p:
        return False
    return a == p if len(a) < EXACT else left_over(a, p) < COPIED


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[。！？!?\n])|(?<=\.)\s", text) if x.strip()]


def refuses(answer: str, prompt: str | None) -> bool:
    """Whether the first or last sentence of an answer declines, asks back or reports a failure, of itself and not because
    the prompt has that sentence."""
    said = sentences(answer)
    asked = norm(prompt or "")
    return any(REFUSAL.search(x) and not (asked and norm(bare(x)) in asked) for x in {*said[:1], *said[-1:]})


def language(text: str) -> bool:
    """Whether the words of a text outside identifiers, paths and quotations are Chinese."""
    rest = IDENTIFIER.sub(" ", bare(text))
    han = len(HAN.findall(rest))
    if len(KANA.findall(rest)) * 8 > han or len(HANGUL.findall(rest)) * 4 > han:
        return False
    return han >= len(LATIN.findall(rest)) or han >= 4 * len(OTHER.findall(rest)) > 0


#: Signs at the end that close nothing.
AFTER = re.compile(r"[”\"’'」』）)】\]*`\s]+$")
#: Ends of what goes on.
OPEN = frozenset("…（(、，,")
ENDED = re.compile(r"[.!?。！？…][\"')”’]*(?=\s|$)")


def signs(text: str) -> str:
    """A text with Han characters, other letters and digits as one sign each."""
    text = re.sub(r"\.\.\.+", "…", FENCE.sub("", text).rstrip())
    return "".join("H" if "㐀" <= c <= "鿿" else "0" if c.isdigit() else "a" if c.isalpha() else c for c in text)


def terminal(text: str) -> str:
    """The terminal context of a text of signs: the last one that is no closing quote or bracket."""
    return (AFTER.sub("", text) or text)[-1:]


def kind_of(prompt: str | None, summary: bool) -> str:
    """What kind of prompt an answer belongs to: headings need no full stop."""
    if summary or prompt is None:
        return "summary" if summary else "unknown"
    if re.search(r"[:;,]\s*$", prompt):
        return "lead"
    return "sentences" if ENDED.search(prompt) else "heading"


Ends = dict[tuple[str, str], tuple[int, int]]


def terminal_counts(answers: DataFrame) -> Ends:
    """How often each sign ends an answer to each kind of prompt and stands inside one.

    Letters and digits are three signs, so what reaches the driver has at most one row for each kind and each
    character of Unicode that is neither (about ten thousand, and in practice some dozens).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: Counter = Counter()
        inner: Counter = Counter()
        for batch in batches:
            for table, text, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and HAN.search(text):
                    kind, seen = kind_of(prompt, table == "threads"), signs(text)
                    ends[kind, terminal(seen)] += 1
                    inner.update({(kind, c): n for c, n in Counter(seen[:-1]).items()})
        keys = list(inner | ends)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([inner[k] for k in keys], pa.int64())], names=["kind", "sign", "e", "i"])

    rows = answers.select("rec_table", "answer", "prompt").mapInArrow(run, "kind string, sign string, e bigint, i bigint").groupBy("kind", "sign").agg(F.sum("e").alias("e"), F.sum("i").alias("i")).where("e > 0").collect()
    return {(r["kind"], r["sign"]): (r["e"], r["i"]) for r in rows}


#: An answer is cut off where less than this part of the occurrences of its last sign are ends.
ENDS_HERE = 0.005


def cut_off(answer: str, prompt: str | None, ends: Ends, summary: bool) -> bool:
    """Whether an answer stops in mid-sentence, by its terminal context, or lacks most sentences of its prompt."""
    seen = signs(answer)
    last = terminal(seen)
    if last in OPEN:
        return not (prompt and not summary and last == "…" and terminal(signs(prompt)) == "…")
    e, i = ends.get((kind_of(prompt, summary), last), (0, 1))
    if e < ENDS_HERE * (e + i):
        return True
    return not summary and 2 * len(END.findall(FENCE.sub("", answer))) < len(ENDED.findall(prompt or ""))


def defect(answer: str | None, prompt: str | None, ends: Ends, summary: bool) -> str | None:
    """The first defect that holds, without what only the thread's mails can show."""
    if answer is None or not (plain := norm(FENCE.sub("", answer).replace("​", ""))) or plain in PLACEHOLDERS:
        return "empty"
    if refuses(answer, prompt):
        return "refusal"
    if prompt and not summary and is_code(prompt) and norm(answer) == norm(prompt):
        return None
    if prompt and copies(answer, prompt):
        return "copied"
    if not language(answer):
        return "wrong_language"
    return "truncated" if cut_off(answer, prompt, ends, summary) else None


def prompted(cache: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(rec_key, answer, prompt) of cached answers; prompt is null where no paragraph has the key.

    The key is a hash of back-end and text, so each text is hashed for each back-end; back-ends are a handful of names.
    """
    backends = [r[0] for r in cache.select("backend").where("backend is not null").distinct().collect()]
    texts = paragraphs.where("text_orig is not null").select("text_orig").distinct()
    keys = texts.select(F.col("text_orig").alias("prompt"), F.explode(F.array(*map(F.lit, backends)) if backends else F.array().cast("array<string>")).alias("backend"))
    keys = keys.select(F.sha2(F.concat_ws(":", "backend", "prompt"), 256).alias("rec_key"), "prompt")
    return cache.select(F.col("cache_key").alias("rec_key"), F.col("translated").alias("answer")).join(keys, "rec_key", "left").select("rec_key", "answer", "prompt")


#: Probes of an answer and their characters.
PROBES, PROBE = 8, 8
JUDGED = "rec_table string, rec_key string, defect string, answer string"


def mail_copies(open_: DataFrame, threads: DataFrame, emails: DataFrame) -> DataFrame:
    """(rec_key) of summaries that give back text of a mail of their thread.

    A copy has most of its parts in the mail, whatever its wrapping: of PROBES probes spread evenly over it at least two
    are there (a short answer is one probe). The JVM keeps the mails with them; compression decides.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")
    shown = flat(F.regexp_replace("answer", "(?i)" + LABEL.pattern.replace("\\s*(?:```\\w*\\s*)?", "\\s*(?:`{3}\\w*\\s*)?"), ""))
    asked = open_.select("rec_key", "answer", one_form("rec_key").alias("thread"), shown.alias("flat")).where("length(flat) >= 4")
    step = (F.length("flat") - PROBE) / (PROBES - 1)
    probes = F.when(F.length("flat") < 2 * PROBE, F.array("flat")).otherwise(F.array(*[F.substring("flat", (F.lit(1) + F.floor(step * k)).cast("int"), F.lit(PROBE)) for k in range(PROBES)]))
    asked = asked.select("rec_key", "thread", "answer", probes.alias("probes"))
    mails = emails.where("body is not null").select(one_form("thread_id").alias("thread"), "body").where("thread is not null")
    held = F.size(F.filter("probes", lambda x: F.contains("text", x)))
    near = mails.join(asked, "thread").withColumn("text", flat(F.col("body"))).where(held >= F.least(F.lit(2), F.size("probes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if copies(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["rec_key"])

    return near.select("rec_key", "answer", "body").mapInArrow(run, "rec_key string").distinct()


def judge(cache: DataFrame, paragraphs: DataFrame, threads: DataFrame, emails: DataFrame) -> DataFrame:
    """(rec_table, rec_key, defect): each defective answer with the first defect that holds.

    Answers are cache.translated and, where processed = 1, threads.summary_zh. An answer without a known prompt is
    judged by itself. Null and blank answers are empty; very long ones are judged whole; repeated keys each count.
    Empty tables give no rows.
    """
    cached = prompted(cache, paragraphs).select(F.lit("translation_cache").alias("rec_table"), "rec_key", "answer", "prompt")
    summed = threads.where("processed = 1").select(F.lit("threads").alias("rec_table"), F.col("id").alias("rec_key"), F.col("summary_zh").alias("answer"), F.col("subject").alias("prompt"))
    pairs = cut(cached.unionByName(summed))
    ends = terminal_counts(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, key, answer, prompt = batch.columns
            found = [defect(a, p, ends, t == "threads") for t, a, p in zip(table.to_pylist(), answer.to_pylist(), prompt.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([table, key, pa.array(found, pa.string()), answer], names=["rec_table", "rec_key", "defect", "answer"])

    judged = cut(pairs.select("rec_table", "rec_key", "answer", "prompt").mapInArrow(run, JUDGED))
    open_ = judged.where("rec_table = 'threads' and (defect is null or defect in ('wrong_language', 'truncated'))")
    copied = mail_copies(open_, threads, emails).withColumn("copied", F.lit(True))
    out = judged.join(copied, "rec_key", "left")
    whole = F.when((F.col("rec_table") == "threads") & F.col("copied"), "copied").otherwise(F.col("defect"))
    return out.select("rec_table", "rec_key", whole.alias("defect")).where("defect is not null")

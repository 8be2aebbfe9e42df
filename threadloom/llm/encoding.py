"""Text that was decoded with a wrong character set: finding it and restoring it.

A hidden Markov model labels the characters of a text. One state is clean; there is one state for each pair of a true
and a wrong character set (UTF-8 read as Windows-1252, Windows-1252 read as CP437, UTF-8 misread twice, ...) and one
for characters that were lost for good (U+FFFD). A state emits a run of characters with the probability that clean text
has the run's inverse transform; clean probabilities are counted over the whole corpus, by a character and its
neighbours. ASCII looks the same in all states, so only runs of other characters are observations. Viterbi labels the
runs, and each labelled span gets its state's inverse transform.

The counts have a proven bound: neighbours are about 110 classes, and only the repertoire of single-byte character
sets is counted with both neighbours; other characters are counted alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = re.compile(r"[^\x00-\x7f]+")
LOST = "�"
#: What a lost character looks like once its UTF-8 form was read as GBK.
REPLACED = {"锟", "拷"}
# The pairs of a true and a wrong character set.
MULTI = ["cp1252", "latin-1", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "koi8-r", "cp866", "mac_roman", "iso8859-2", "iso8859-15", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr"]
SINGLE = ["cp437", "cp850", "cp852", "cp866", "cp1250", "cp1251", "cp1253", "koi8-r", "mac_roman", "iso8859-2", "iso8859-5"]
PAIRS = (
    [("utf-8", w) for w in MULTI]
    + [("cp1252", w) for w in SINGLE]
    + [(t, "cp1252") for t in ("gbk", "big5", "shift_jis", "euc_kr", "cp1251", "koi8-r", "cp866", "cp1250", "mac_roman", "cp437", "cp850")]
    + [(t, "latin-1") for t in ("gbk", "big5", "shift_jis", "cp1251", "koi8-r")]
    + [("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1250", "cp1251"), ("cp1250", "cp437"), ("cp1250", "cp850"), ("cp1251", "mac_roman"), ("gbk", "cp437"), ("gbk", "big5")]
)
#: States: clean, lost, each pair, each pair of UTF-8 misread twice.
TWICE = ["cp1252", "latin-1"]
STATES = [None, "lost", *PAIRS, *[("utf-8", w, "utf-8", w) for w in TWICE]]
#: Probabilities that a text has damage of one kind, and that a span of it ends before the next run.
ENTER, LEAVE = math.log(1e-3), math.log(1e-2)
CONTRACTED = re.compile(r"(?:[stmd](?![A-Za-z])|(?:re|ve|ll)(?![A-Za-z]))")
#: Words near garbled characters that are shown and discussed rather than suffered.
TALK = re.compile(r"(?i)charset|encod|umlaut|accent|mojibake|garbl|code ?page|unicode|utf-?8|latin-?1|乱码|编码|кодировк|literal string|damaged|zeichensatz|kodierung|encodage")


def _bytes(text: str, wrong: str) -> bytes:
    """The bytes that a wrong decoding had; C1 controls stand for bytes that Windows character sets leave open."""
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        if not wrong.startswith("cp125"):
            raise
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else c.encode(wrong) for c in text)


def undo(text: str, state: tuple | None) -> str | None:
    """The inverse transform of a state; null where the text can't have come from it."""
    try:
        for true, wrong in zip(state[::2], state[1::2], strict=True):
            text = _bytes(text, wrong).decode(true)
    except (UnicodeError, LookupError):
        return None
    return text


_REPERTOIRE = frozenset(c for w in (*SINGLE, "cp1252", "cp1254") for b in range(128, 256) if (c := bytes([b]).decode(w, "ignore"))) | {LOST}


def neighbour(c: str) -> str:
    """The class of a neighbour: ASCII letters stand for themselves."""
    if not c:
        return " "
    if c < "\x80":
        return c if c.isalpha() or c in "\"'.,:;<>-()[]" else "0" if c.isdigit() else " " if c.isspace() else "#"
    name = unicodedata.category(c)
    if name[0] != "L":
        return "\x02" if name[0] in "PZ" else "\x03"
    code = ord(c)
    if code < 0x250:
        return "\x04" if c.islower() else "\x05"
    return "\x06" if 0x370 <= code < 0x400 else "\x07" if 0x400 <= code < 0x530 else "\x08" if code >= 0x2E80 else "\x0e"


def _places(text: str, m: re.Match) -> tuple[str, str, str]:
    a, b = m.span()
    right = text[b : b + 3]
    return text[a - 1 : a], m.group(), right if CONTRACTED.match(right) else right[:1]


def contexts(left: str, run: str, right: str) -> Iterator[tuple[str, str, str]]:
    """(left class, character, right class) of each character of a run; the classes are blank for rarer repertoires."""
    whole = [left, *run, right[:1]]
    for k, c in enumerate(run, 1):
        yield (neighbour(whole[k - 1]), c, neighbour(whole[k + 1])) if c in _REPERTOIRE else ("", c, "")


def counts(df: DataFrame, fields: list[str]) -> dict[tuple[str, str, str], int]:
    """How often each character occurs between neighbours, over all rows and fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for column in batch.columns:
                for text in column.to_pylist():
                    if text and not text.isascii():
                        seen.update((l, run, r[:1]) for l, run, r in (_places(text, m) for m in RUN.finditer(text)))
            if len(seen) > 200_000:
                yield flush(seen)
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        out: Counter = Counter()
        for place, n in seen.items():
            for k in contexts(*place):
                out[k] += n
        seen.clear()
        l, c, r = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(l, pa.string()), pa.array(c, pa.string()), pa.array(r, pa.string()), pa.array(list(out.values()), pa.int64())], names=["l", "c", "r", "n"])

    raw = df.select(*[F.col(f).cast("string") for f in fields]).mapInArrow(run, "l string, c string, r string, n bigint")
    rows = raw.groupBy("l", "c", "r").agg(F.sum("n").alias("n")).collect()  # bounded, see above
    return {(x["l"], x["c"], x["r"]): x["n"] for x in rows}


class Model:
    """The scores of runs under each state."""

    def __init__(self, seen: dict[tuple[str, str, str], int]):
        self.total = max(1, sum(seen.values()))
        self.both, self.alone, self.left, self.right = seen, Counter(), Counter(), Counter()
        for (l, c, r), n in seen.items():
            self.alone[c] += n
            self.left[l, c] += n
            self.right[c, r] += n
        self.known: dict[tuple[str, str, str], np.ndarray] = {}

    def character(self, l: str, c: str, r: str) -> float:
        """The log probability of a character between two classes in clean text."""
        one = self.alone[c]
        if not l:
            p = (one + 0.01) / self.total
            return math.log(p * (1e-2 if c in _REPERTOIRE else 1.0))
        n = self.both.get((l, c, r), 0) * 0.75 + 0.2 * self.left[l, c] * self.right[c, r] / max(1, one) + 1e-4 * one + 1e-6
        p = n / self.total
        code = ord(c)
        if (l.isascii() and l.isalpha()) or (r.isascii() and r.isalpha()):
            # letters of another script, symbols and controls don't stand in a Latin word
            if 0x370 <= code < 0x530 or 0x2070 <= code < 0x20A0 or 0x2190 <= code < 0x2E80 or 0x80 <= code < 0xA0 or c in "¦¤¬¸¨¯´ˆ˜ˇ":
                p *= 1e-3
            elif not c.isalpha() and c not in "’‘-–—·" and l.isalpha() and r.isalpha():
                p *= 1e-3
            elif code < 0x250 and c.isupper() and (l.islower() or (l.isupper() and r.islower())):
                p *= 1e-2
        elif 0x80 <= code < 0xA0:
            p *= 1e-3
        return math.log(p)

    def text(self, left: str, run: str, right: str) -> float:
        whole = sum(self.character(*k) for k in contexts(left, run, right))
        # scripts without blanks seldom touch Latin letters
        touches = sum(ord(c) >= 0x2E80 and side.isascii() and side.isalpha() for c, side in ((run[:1], left), (run[-1:], right[:1])) if c)
        return whole - 5.0 * touches

    def scores(self, place: tuple[str, str, str]) -> np.ndarray:
        if (found := self.known.get(place)) is None:
            left, run, right = place
            found = np.full(len(STATES), -1e9)
            found[0] = self.text(left, run, right)
            if LOST in run or REPLACED <= set(run):
                found[0], found[1] = -1e6, 0.0
            else:
                for k, state in enumerate(STATES[2:], 2):
                    back = undo(run, state)
                    if back is not None and not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") and c not in "\t\n" for c in back):
                        found[k] = self.text(left, back, right)
                        # an apostrophe that makes a contraction of what is none otherwise
                        if back == "’" and run != back and left.isalpha() and CONTRACTED.match(right):
                            found[k] += 5.0
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[place] = found
        return found


def label(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(start, end, state) of each run whose likeliest state is not clean."""
    runs = list(RUN.finditer(text))
    scores = [model.scores(_places(text, m)) for m in runs]
    if all(s[0] >= s.max() + ENTER for s in scores) and sum(max(0.0, s.max() - s[0]) for s in scores) <= -ENTER:
        return []
    best = np.full(len(STATES), ENTER)
    best[0] = 0.0
    back = []
    for s in scores:
        over = int(best.argmax())
        stay, move = best, best[over] + np.where(np.arange(len(STATES)) == 0, LEAVE if over else 0.0, ENTER)
        came = np.where(stay >= move, np.arange(len(STATES)), over)
        back.append(came)
        best = np.maximum(stay, move) + s
    k, out = int(best.argmax()), []
    for m, came in zip(reversed(runs), reversed(back), strict=True):
        if k:
            out.append((m.start(), m.end(), k))
        k = int(came[k])
    return out[::-1]


def discussed(text: str, start: int, end: int) -> bool:
    """Whether a span is shown as an example: it stands alone, and the words around it talk of character sets."""
    if (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()) and text[start - 1 : start] != '"':
        return False
    return bool(TALK.search(text[max(0, start - 150) : start] + " " + text[end : end + 150]))


def damage(text: str, model: Model) -> list[tuple[int, int, int]]:
    """The labelled spans that their state's inverse transform changes and that aren't examples."""
    spans = [x for x in label(text, model) if STATES[x[2]] == "lost" or undo(text[x[0] : x[1]], STATES[x[2]]) != text[x[0] : x[1]]]
    return [x for x in spans if not discussed(text, x[0], x[1])]


def restore(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], text[a:b] if STATES[k] == "lost" else undo(text[a:b], STATES[k])]
        at = b
    return "".join(out) + text[at:]


def find(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(key, field, damaged, restored, pairs): each damaged text field of each row.

    restored has every span for which a pair of character sets was found put right; lost characters stay. pairs names
    the states of the spans. Null and empty fields and pure ASCII are never damaged. Repeated rows each count; extra
    columns are not read. Whole texts are labelled, however long. An empty table gives an empty one.
    """
    sent = df.sparkSession.sparkContext.broadcast(counts(df, fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value)
        for batch in batches:
            keys, names, was, now, pairs = [], [], [], [], []
            for field, column in zip(fields, batch.columns[1:], strict=True):
                for k, text in enumerate(column.to_pylist()):
                    if text and not text.isascii() and (spans := damage(text, model)):
                        keys.append(k)
                        names.append(field)
                        was.append(text)
                        now.append(restore(text, spans))
                        pairs.append(sorted({"lost" if (s := STATES[x[2]]) == "lost" else ">".join(s) for x in spans}))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(names, pa.string()), pa.array(was, pa.string()), pa.array(now, pa.string()), pa.array(pairs, pa.list_(pa.string()))], names=[key, "field", "damaged", "restored", "pairs"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[F.col(f).cast("string") for f in fields]).mapInArrow(run, f"`{key}` {kind}, field string, damaged string, restored string, pairs array<string>")

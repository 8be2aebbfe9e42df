"""Text of mail bodies that needs more than an expression: folding, splitting, chunking, alignment, translation.

Each function works on one text in Python; `apply` runs them over a column in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of lines that are never prose, and of review tags.
DIFF_STARTS = (">", "+", "-", "diff ", "@@", "index ")
TAG_STARTS = ("Signed-off-by:", "Reviewed-by:", "Acked-by:", "Tested-by:", "Cc:", "Link:", "Fixes:", "Reported-by:")
# Patterns of code, log and data lines, tried on the stripped line; `^` ones at its start only.
CODE_PATTERNS = [
    r"\w\+0x[0-9a-f]+(?:/0x[0-9a-f]+)?",
    r"\{[.\-]+\}-\{\d+:\d+\}",
    r"^\S+\.\w+\s+\|\s+\d+",
    r"\d+\s+files?\s+changed",
    r"^(?:struct\s+\w|#define\s|static\s|void\s|int\s|unsigned\s|long\s|char\s|const\s|enum\s|typedef\s|return\s|if\s*\(|for\s*\(|while\s*\()",
    r"^(?:WARNING:|BUG:|Call Trace:|<TASK>|</TASK>|RIP:|RSP:|RAX:|CPU:|PID:|Comm:|Workqueue:)",
    r"^(?:kernel|include|arch|drivers|fs|mm|net|lib)/\S+",
    r"^(?:0x[0-9a-f]{4,}|[0-9a-f]{12,})\b",
    r"^->\s*#\d+",
    r"\d{1,3}(?:,\d{3})+",
    r"^\w+_\w+\s+[\d,]+",
    r"[|][-=]{2,}|[-=]{2,}[|]",
    r"[|][-=*]+[|]",
    r">[A-Z]\s+\||\|<",
    r"^[a-zA-Z]\s*=\s*\d+",
    r"^\[\s*\d+\.\d+\]",
    r"^[\d.]+\s*(?:us|ms|ns)\s*\|",
    r"^\d+\.\d+%\s+\S+",
    r"^[\d,]+\s+\S+\s+\([\d.]+%\)",
    r"^(?:R[A-Z]{1,2}|CR[0-4]|DR[0-7]|FS|GS|CS|SS|EFLAGS):",
    r"^\[<[0-9a-f]+>\]",
    r"^\?\s+\S+\+0x[0-9a-f]+",
    r"^(?:->|<-)#\d+|lock_type:\s*\d+",
    r"^(?:/proc/|/sys/)",
    r"^CONFIG_[A-Z0-9_]+=",
    r"^commit [0-9a-f]{7,40}\b",
    r"^\S.*\(\d+\):$",
    r"^>\s*[+\-]",
    r"^[=~#*]{4,}$|^-{4,}$",
    r"^CPU\d+$",
    r"^lock\(",
    r"^(?:Chain exists of|Possible unsafe|other info that might)",
    r"^\d+\s+locks?\s+held\s+by\s+",
    r"^#\d+:\s+[0-9a-f]",
    r"^(?:Hardware name:|Not tainted)",
    r"^\w+:\s+(?:prev_comm|next_comm|tid=|eligible=)",
    r"^\./",
    r"^t=\d+\s+V=\d+",
    r"^(?:create|delete)\s+mode\s+\d+",
    r"^rename\s+(?:from|to)\s+",
]
_AT_START = re.compile("|".join(f"(?:{p[1:]})" for p in CODE_PATTERNS if p.startswith("^") and "|^" not in p and not p.startswith("^(?:->")))
_ANYWHERE = re.compile("|".join(f"(?:{p})" for p in CODE_PATTERNS if not p.startswith("^") or "|^" in p or p.startswith("^(?:->")))
_TRACE = re.compile(r"^\S+-\d+\s+\[?\d+\]?")
_DIFFSTAT = re.compile(r"^[ \t]*\S+[\w./]+\s+\|\s+\d+")
_CHANGED = re.compile(r"^\s*\d+\s+files?\s+changed")
_FOLDED = re.compile(r"\[\.\.\..*\.\.\.\]")
FOLD_MARK = "[...{} 行引用已省略...]"


def apply(f: Callable, kind: str, *columns: Column) -> Column:
    """A function of texts as a vectorised column function; null texts are ''."""

    @F.pandas_udf(kind)
    def run(*series):  # noqa: ANN002, ANN202
        import pandas as pd

        return pd.Series([f(*["" if x is None else x for x in row]) for row in zip(*series, strict=True)], dtype=object)

    return run(*columns)


def is_code_line(line: str) -> bool:
    """Whether a line is code, log output or data rather than prose."""
    s = line.strip()
    if not s:
        return False
    if _AT_START.match(s) or _ANYWHERE.search(s):
        return True
    words = s.split()
    aligned = re.search(r"\S\s{2,}\S", s) and len(words) <= 8
    if aligned and (re.search(r"\d|\w_\w", s) or any(len(w) > 1 and w.isupper() for w in words)):
        return True
    if _TRACE.match(s) and any(x in s for x in ("|", "=>", "<-")):
        return True
    return len(s) > 5 and sum(map(str.isalpha, s)) < 0.3 * len(s)


def strip_patch(body: str) -> str:
    """A patch mail's message: what stands before the first `---` line that a diff or diffstat follows."""
    lines = body.split("\n")
    follows = False
    cut = None
    for k in range(len(lines) - 1, 0, -1):  # from the end, so that what follows each line is known
        if lines[k].strip() == "---" and follows:
            cut = k
        follows = follows or "diff --git" in lines[k] or bool(re.match(r"\s+\S+.*\|\s+\d+", lines[k]))
    return body if cut is None else "\n".join(lines[:cut]).strip()


def fold_quotes(body: str) -> str:
    """Runs of more than three quoted lines folded: to a mark and the last two, or to the mark alone at the end."""
    lines = body.split("\n")
    out: list[str] = []
    k = 0
    while k < len(lines):
        run = k
        while run < len(lines) and lines[run].lstrip().startswith(">"):
            run += 1
        size = run - k
        if size > 3:
            keep = 2 if run < len(lines) else 0
            out += [FOLD_MARK.format(size - keep), *lines[run - keep : run]]
        else:
            out += lines[k:run]
        if run < len(lines):
            out.append(lines[run])
        k = run + 1
    return "\n".join(out)


def preprocess(priority: int, body: str) -> str:
    """A body without signature, and without its patch (low) or with folded quotations (medium, high)."""
    text = re.split(r"\n-- \n", body, maxsplit=1)[0].rstrip()
    return (strip_patch(text) if priority == 1 else fold_quotes(text)).strip()


def split_diff(body: str) -> tuple[str, str]:
    """(text, diff): a fenced diff, else what begins with a diffstat or the first `--- a/` header."""
    if m := re.search(r"```diff\s*\n(.*?)```", body, re.S):
        rest = body[m.end() :].strip()
        return "\n".join([body[: m.start()].rstrip(), *([rest] if rest else [])]), m.group(1).strip()
    lines = body.split("\n")
    start = None
    changed = next((k for k, x in enumerate(lines) if _CHANGED.match(x)), None)
    if changed is not None:
        top = changed
        while top and _DIFFSTAT.match(lines[top - 1]):
            top -= 1
        if top < changed:
            start = top - 1 if top and lines[top - 1].rstrip() == "---" else top
    if start is None:
        start = next((k for k, x in enumerate(lines) if x.startswith("--- a/")), None)
        if start and lines[start - 1].rstrip() == "---":
            start -= 1
    return (body, "") if start is None else ("\n".join(lines[:start]).rstrip(), "\n".join(lines[start:]).strip())


def should_translate(body: str) -> bool:
    """Whether the text without its diff has 20 characters and at most 70 % lines that look like a diff."""
    text = split_diff(body)[0].strip()
    lines = text.splitlines()
    return len(body.strip()) >= 20 and len(text) >= 20 and sum(x.startswith(("+", "-", "diff ", "@@", "index ")) for x in lines) <= 0.7 * len(lines)


def paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"\n\n+", text.strip()) if p.strip()]


def untranslatable(paragraph: str) -> bool:
    """Whether a paragraph is quotation, tags, code, links or data and so stays as it is."""
    lines = [x.strip() for x in paragraph.strip().splitlines() if x.strip()]
    if not lines:
        return False
    whole = paragraph.strip()
    if re.fullmatch(r"(?s)\[\.\.\..*\.\.\.\]", whole):
        return True  # a fold mark, also over several lines
    quoted = [x.startswith(">") for x in lines]
    folded = [x.startswith("[...") and "...]" in x for x in lines]
    technical = [is_code_line(x) or x.startswith(DIFF_STARTS) for x in lines]
    if all(a or b for a, b in zip(quoted, folded, strict=True)) or all(x.startswith(TAG_STARTS) for x in lines) or all(technical) or whole.startswith("```"):
        return True
    if all(x.startswith(("http://", "https://", "git://")) for x in lines) or all(re.match(r"-?\d+\.?\d*%\s+\S+", x) for x in lines):
        return True
    kept = sum(a or b or x.startswith(TAG_STARTS) for a, b, x in zip(technical, folded, lines, strict=True))
    if len(lines) > 1 and kept >= 0.6 * len(lines):
        return True
    text = " ".join(lines)
    return len(text) > 20 and sum(map(str.isalpha, text)) < 0.3 * len(text)


# Words with which a short sentence begins.
SENTENCE_STARTS = {"this", "the", "a", "an", "it", "we", "i", "he", "she", "they", "you", "there", "here", "please", "also", "note"}


def fixed_paragraphs(parts: list[str]) -> list[bool]:
    """Which paragraphs of a text stay as they are: by themselves, or as short headings and labels between data."""
    alone = [untranslatable(p) for p in parts]
    out = list(alone)
    for k, p in enumerate(parts):
        sides = [0 <= j < len(parts) and alone[j] for j in (k - 1, k + 1)]
        if alone[k] or not any(sides):
            continue
        words = p.split()
        lines = [x for x in p.strip().splitlines() if x.strip()]
        sentence = p.strip().endswith((".", "!", "?")) or bool(words) and words[0].lower() in SENTENCE_STARTS
        heading = len(words) <= 5 and all(sides) and not sentence
        out[k] = heading or (len(lines) <= 2 and all(re.match(r"\s*\w[\w\s]*:\s+\S", x) for x in lines))
    return out


def merge_soft_breaks(text: str) -> str:
    """Prose lines joined within paragraphs; code, quotations, tags and list items keep their lines."""
    out: list[str] = []
    open_ = False
    for line in text.split("\n"):
        s = line.strip()
        if not s or s.startswith((*DIFF_STARTS, *TAG_STARTS)) or is_code_line(line):
            out.append(line if s else "")
            open_ = False
        elif open_ and not re.match(r"(?:\d+[.)]\s|[*•]\s)", s):
            out[-1] += f" {s}"
        else:
            out.append(s)
            open_ = True
    return "\n".join(out)


def drop_backticks(text: str) -> str:
    """A back-end's text without stray back-ticks."""
    kept = [x for x in text.split("\n") if x.strip() != "`"]
    return "\n".join(x.rstrip()[:-1].rstrip() if len(x.strip()) > 1 and x.strip().endswith("`") else x for x in kept)


def comment_text(lines: list[str]) -> str:
    """The prose of a comment's lines, without comment marks and diff prefixes."""
    out = []
    for line in lines:
        s = re.sub(r"^[+\- ]", "", line.lstrip()).strip()
        s = re.sub(r"^\*\s?", "", re.sub(r"\s*\*+/$", "", re.sub(r"^/\*+\s*", "", s))).strip()
        out += [s] if s else []
    return " ".join(out)


def hard_split(line: str, size: int) -> list[str]:
    return [line[k : k + size] for k in range(0, len(line), size)]


def chunks(text: str, size: int) -> list[str]:
    """A text in parts of at most `size` characters, packed line by line; longer lines are cut."""
    out: list[str] = []
    for line in text.split("\n"):
        for piece in hard_split(line, size) or [""]:
            if out and len(out[-1]) + 1 + len(piece) <= size:
                out[-1] += "\n" + piece
            else:
                out.append(piece)
    return out


def wrap(body: str, width: int = 80) -> str:
    """Prose lines wrapped at a width; diffs, quotations and lines with tabs keep theirs."""
    import textwrap

    out: list[str] = []
    for line in body.split("\n"):
        keep = len(line) <= width or line.startswith(("+", "-", "@@", "diff ", "index ", ">", "\t", "    "))
        out += [line] if keep else textwrap.wrap(line, width, break_long_words=False, break_on_hyphens=False) or [""]
    return "\n".join(out)


def similarity(translated: str, original: str) -> float:
    """How likely two paragraphs are a translation pair: length, words and shared tokens; 0 to 1."""
    a, b = translated.strip(), original.strip()
    squeezed = [re.sub(r"\s+", " ", x) for x in (a, b)]
    la, lb = ({y for x in t.splitlines() if (y := x.strip())} for t in (a, b))
    if not a or not b or squeezed[0] == squeezed[1] or (la and lb and len(la & lb) >= 0.8 * len(lb)):
        return 0.0
    han = len(re.findall(r"[一-鿿]", a))
    ratio = lambda x, y: min(x, y) / max(x, y) if max(x, y) > 0 else 0.0
    size = ratio(len(a) + han, len(b))
    if size < 0.15:
        return 0.0
    score = 0.3 * size + 0.25 * ratio(0.5 * han + len(re.findall("[A-Za-z]+", a)), len(b.split()))
    ta, tb = (set(re.findall(r"[A-Z][a-z]+|[A-Z]{2,}|[a-z_]{4,}|\d+", x)) for x in (a, b))
    shared = len(ta & tb)
    if tb:
        score += min(0.4 * shared / len(tb) + 0.05, 0.4) if shared >= 2 else 0.35 * shared / len(tb)
        score *= 0.4 if len(tb) >= 3 and not shared else 1.0
    else:
        score += 0.05
    return min(1.0, score + (0.15 if han else 0.0))


SKIP, BONUS, LEAST = -0.15, 0.08, 0.15


def align(translated: list[str], originals: list[str], fixed: list[bool]) -> list[int | None]:
    """For each original paragraph the index of its translation, in order; None where it is fixed or has none.

    The best monotone matching: pairs score their similarity (neighbouring pairs a bonus), a skipped original costs. If fewer
    originals find a partner than don't, paragraphs are paired in sequence.
    """
    todo = [k for k, f in enumerate(fixed) if not f]
    usable = [k for k, p in enumerate(translated) if not untranslatable(p)]
    if not todo or not usable:
        return [None] * len(originals)
    score = [[similarity(translated[c], originals[e]) for c in usable] for e in todo]
    for i in range(len(todo) - 1):  # two originals under one translation
        both = originals[todo[i]] + "\n" + originals[todo[i + 1]]
        for j, c in enumerate(usable):
            s = similarity(translated[c], both)
            if s >= 0.4 and s > max(score[i][j], score[i + 1][j]) + 0.1:
                score[i][j] = s
    n, m = len(todo), len(usable)
    best = [[(0.0, "start")] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = (best[i - 1][0][0] + SKIP, "original")
        for j in range(1, m + 1):
            options = [(best[i - 1][j][0] + SKIP, "original"), (best[i][j - 1][0], "translation")]
            if score[i - 1][j - 1] >= LEAST:
                options.append((best[i - 1][j - 1][0] + score[i - 1][j - 1] + (BONUS if best[i - 1][j - 1][1] == "pair" else 0.0), "pair"))
            best[i][j] = max(options, key=lambda x: x[0])
    found: dict[int, int] = {}
    i, j = n, m
    while i and j:
        step = best[i][j][1]
        if step == "pair":
            found[todo[i - 1]] = usable[j - 1]
        i, j = i - (step != "translation"), j - (step != "original")
    if 2 * len(found) < len(todo):
        found = dict(zip(todo, usable, strict=False))
    return [found.get(k) for k in range(len(originals))]


def is_diff_meta(line: str) -> bool:
    s = line.strip()
    return s == "---" or bool(_DIFFSTAT.match(s) or _CHANGED.match(s) or re.match(r"(?:create|delete)\s+mode\s+\d+|rename\s+", s))


def keep_text(aligned: list[tuple[str, str | None]], text: str) -> list[tuple[str, str | None]]:
    """Of aligned paragraphs those of the text part; a mixed paragraph is cut where its diff begins."""
    whole = {p.strip() for p in paragraphs(text)}
    lines = {x.strip() for x in text.splitlines() if x.strip()}
    out: list[tuple[str, str | None]] = []
    for original, translated in aligned:
        s = original.strip()
        if s in whole:
            out.append((original, translated))
            continue
        if s.startswith(("diff --git", "--- a/", "+++ b/", "@@", "index ")):
            continue
        kept, hit = [], False
        for line in s.splitlines():
            if line.strip() not in lines and is_diff_meta(line):
                hit = True
                break
            kept += [line] if line.strip() else []
        if kept:
            out.append(("\n".join(kept), None if hit else translated))
    return out or aligned

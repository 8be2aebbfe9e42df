"""Text back-ends: pluggable, and deterministic where no network is at hand."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from threadloom.functions import bodies


class TextBackend(Protocol):
    name: str

    def translate(self, text: str) -> str: ...

    def judge(self, subject: str, sender: str, body: str) -> tuple[float, str]: ...

    def summarise(self, text: str) -> str: ...


class Identity:
    """Gives texts back unchanged; finds every mail relevant."""

    name = "identity"

    def translate(self, text: str) -> str:
        return text

    def judge(self, subject: str, sender: str, body: str) -> tuple[float, str]:
        return 1.0, "YES"

    def summarise(self, text: str) -> str:
        return text[:500]


class Dictionary(Identity):
    """Replaces whole paragraphs by a table, other text by a marked copy; a mail is relevant if it has one of the words."""

    name = "dict"

    def __init__(self, table: dict[str, str], words: list[str] | None = None, mark: str = "译:"):
        self.table, self.words, self.mark = table, words or [], mark

    def translate(self, text: str) -> str:
        return self.table.get(text, self.mark + text)

    def judge(self, subject: str, sender: str, body: str) -> tuple[float, str]:
        found = next((w for w in self.words if w in f"{subject} {body}".lower()), "")
        return (1.0, f"YES {found}") if found else (0.0, "NO")


def with_retries(call: Callable[[str], str], attempts: int = 3, sleep: Callable[[float], None] | None = None) -> Callable[[str], str]:
    """A call that is tried again after min(2^n, 4) seconds, and on the last failure in halves, line by line."""
    import time

    wait = sleep or time.sleep

    def run(text: str) -> str:
        for n in range(attempts):
            try:
                return call(text)
            except (OSError, TimeoutError):
                wait(min(2**n, 4))
            except ValueError:  # the text itself is refused
                break
        lines = text.split("\n")
        if len(lines) < 2:
            return text
        half = len(lines) // 2
        return "\n".join([run("\n".join(lines[:half])), run("\n".join(lines[half:]))])

    return run


def translate_aligned(backend: TextBackend, body: str) -> list[tuple[str, str | None]]:
    """(paragraph, translation) of a body's text; None where a paragraph stays as it is."""
    if not bodies.should_translate(body):
        return []
    text, _ = bodies.split_diff(body)
    parts = bodies.paragraphs(text)
    return [(p, None if fixed else bodies.drop_backticks(backend.translate(bodies.merge_soft_breaks(p)))) for p, fixed in zip(parts, bodies.fixed_paragraphs(parts), strict=True)]


def translate_comments(backend: TextBackend, diff: str) -> str:
    """A diff with a marked line of translation under each comment that isn't a licence text."""
    import re

    licence = ("license", "licence", "copyright", "warranty", "spdx-license-identifier")
    out: list[str] = []
    block: list[str] = []
    for line in diff.split("\n"):
        out.append(line)
        code = line[1:] if line[:1] in "+- " else line
        if block or "/*" in code:
            block.append(code[code.index("/*") :] if not block else code)
            if "*/" not in code:
                continue
            text, block = bodies.comment_text(block), []
        elif m := re.search(r"//\s*(.+)$", code):
            text = m.group(1).strip()
        else:
            continue
        if len(re.findall("[A-Za-z]{2,}", text)) >= 2 and sum(w in text.lower() for w in licence) < 2:
            out.append("\0CN\0" + backend.translate(text))
    return "\n".join(out)

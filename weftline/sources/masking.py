"""Source text with its comments and strings blanked, and what follows from its braces.

All later matching is done on the blanked text, whose positions are those of
the source; so braces, keywords and call marks in comments or strings do not
count, whatever the language.
"""

from __future__ import annotations

import re
from bisect import bisect_right


class Source:
    """A file's text, its blanked form, brace depths and line numbers."""

    def __init__(self, text: str, comments: tuple[str, ...] = ("//",), block: bool = True, quotes: str = "\"'`", triple: bool = False):
        self.text = text
        self.plain = blank(text, comments, block, quotes, triple)
        self._starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.depth = [0] * (len(text) + 1)
        self.closing: dict[int, int] = {}
        level, stack = 0, []
        for i, c in enumerate(self.plain):
            if c == "}":
                level = max(0, level - 1)
                if stack:
                    self.closing[stack.pop()] = i
            self.depth[i] = level
            if c == "{":
                stack.append(i)
                level += 1
        self.depth[len(text)] = level

    def line(self, at: int) -> int:
        return bisect_right(self._starts, at)

    def lines(self, start: int, end: int) -> tuple[int, int]:
        return self.line(start), self.line(max(start, end - 1))

    @property
    def last_line(self) -> int:
        return max(1, len(self.text.splitlines()))

    def body(self, at: int, stop: str = ";") -> tuple[int, int] | None:
        """The braces of the body that opens after `at`, before any of the stop characters at the same depth."""
        for i in range(at, len(self.plain)):
            c = self.plain[i]
            if c == "{":
                return (i, self.closing[i]) if i in self.closing else None
            if c in stop or c == "}":
                return None
        return None

    def parenthesis(self, at: int) -> int | None:
        """The position of the parenthesis that closes the one at `at`."""
        level = 0
        for i in range(at, len(self.plain)):
            level += {"(": 1, ")": -1}.get(self.plain[i], 0)
            if level == 0:
                return i
        return None


def blank(text: str, comments: tuple[str, ...], block: bool, quotes: str, triple: bool) -> str:
    """The text with the insides of comments and strings as blanks; newlines stay."""
    marks = [re.escape(c) + r"[^\n]*" for c in comments]
    if block:
        marks.append(r"/\*.*?(?:\*/|\Z)")
    if triple:
        marks.append(r'""".*?(?:"""|\Z)')
    for q in quotes:
        inner = r"(?:\\.|[^\\`])" if q == "`" else rf"(?:\\.|[^\\\n{q}])"
        marks.append(rf"{q}{inner}*{q}")
    found = re.compile("|".join(marks), re.S)

    def hide(m: re.Match) -> str:
        s = m.group()
        if s[0] in quotes and len(s) >= 2:
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]
        return re.sub(r"[^\n]", " ", s)

    return found.sub(hide, text)


def split_top(text: str, separator: str = ",") -> list[str]:
    """The parts of a list, at separators outside brackets."""
    out, level, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            level += 1
        elif c in ">)]}" and not (c == ">" and text[i - 1 : i] in ("=", "-")):
            level -= 1
        elif c == separator and level <= 0:
            out.append(text[start:i].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [p for p in out if p]

"""Tokens of source text: words, quoted literals, and single marks, with their places."""

from __future__ import annotations

import re

_SCAN = re.compile(r"'[^'\n]*'?|\"[^\"\n]*\"?|[A-Za-z0-9_-]+|\S")
_QUOTES = "'\""


class Phrase:
    """A text and its tokens; places are token numbers, and -1 or a place behind the end mean "none"."""

    __slots__ = ("ends", "starts", "text", "tokens", "upper")

    def __init__(self, text: str):
        self.text = text
        found = list(_SCAN.finditer(text))
        self.tokens = [m.group() for m in found]
        self.starts = [m.start() for m in found]
        self.ends = [m.end() for m in found]
        #: Words in upper case; empty for literals and marks.
        self.upper = [t.upper() if t[0] not in _QUOTES and (t[0].isalnum() or t[0] in "_-") else "" for t in self.tokens]

    def __len__(self) -> int:
        return len(self.tokens)

    def word(self, at: int) -> str:
        """The word at a place in upper case, or an empty text."""
        return self.upper[at] if 0 <= at < len(self.tokens) else ""

    def mark(self, at: int) -> str:
        """The literal or mark at a place, or an empty text."""
        return self.tokens[at] if 0 <= at < len(self.tokens) and not self.upper[at] else ""

    def find(self, word: str, at: int = 0) -> int:
        """The first place of a word from ``at`` on."""
        try:
            return self.upper.index(word, at)
        except ValueError:
            return -1

    def part(self, begin: int, end: int | None = None) -> str:
        """The text from a token up to another (the end of the text)."""
        end = len(self.tokens) if end is None else end
        return self.text[self.starts[begin] : self.ends[end - 1]] if 0 <= begin < end else ""

    def touching(self, at: int) -> bool:
        """Whether no space stands between a token and the next."""
        return at + 1 < len(self.tokens) and self.ends[at] == self.starts[at + 1]

    def literal(self, at: int) -> str | None:
        """The content of a quoted literal, None for anything else."""
        t = self.mark(at)
        return t.strip(t[0]) if t and t[0] in _QUOTES else None

    def name(self, at: int, also: str = "", dots: int = 0) -> str:
        """A word with the words and signs of ``also`` that touch it, and up to ``dots`` points between words."""
        if not self.word(at):
            return ""
        last = at
        while self.touching(last):
            if self.upper[last + 1] or self.tokens[last + 1] in also:
                last += 1
            elif dots and self.tokens[last + 1] == "." and self.touching(last + 1) and self.upper[last + 2]:
                dots -= 1
                last += 2
            else:
                break
        return self.text[self.starts[at] : self.ends[last]]

    def option(self, word: str, at: int = 0) -> str:
        """What stands in brackets behind a word: the word or the content of the literal."""
        while (at := self.find(word, at)) >= 0:
            if self.mark(at + 1) == "(":
                content = self.literal(at + 2)
                return self.name(at + 2) if content is None else content
            at += 1
        return ""


def mentions(text: str, name: str) -> bool:
    """Whether a name stands in a text without a letter, digit or underscore on either side."""
    at = text.find(name)
    while at >= 0:
        before, after = text[at - 1 : at], text[at + len(name) : at + len(name) + 1]
        if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
            return True
        at = text.find(name, at + 1)
    return False

"""Heads of declarations: a line's code as words and signs, read from the left; and sources without their texts and comments."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

_ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Head:
    """Words (letters, digits, _ and `more`) and single signs of a line, with a place to read from. White space only
    parts them."""

    def __init__(self, line: str, more: str = ""):
        self.line = line
        found = [(m[0], m.start(), m.end()) for m in re.finditer(rf"[A-Za-z0-9_{re.escape(more)}]+|[^\sA-Za-z0-9_{re.escape(more)}]", line)]
        self.words, self.starts, self.ends = ([x[i] for x in found] for i in range(3))
        self.at = 0

    def __bool__(self) -> bool:
        return self.at < len(self.words)

    @property
    def next(self) -> str:
        return self.words[self.at] if self else ""

    def spaced(self) -> bool:
        """White space, or nothing, stands before the next word."""
        return not self.at or not self or self.starts[self.at] > self.ends[self.at - 1]

    def take(self, words: Collection[str]) -> str:
        """The next word, if it is one of words."""
        if self.next and self.next in words:
            self.at += 1
            return self.words[self.at - 1]
        return ""

    def skip(self, words: Collection[str]) -> list[str]:
        """All next words that are among words."""
        out = []
        while x := self.take(words):
            out.append(x)
        return out

    def name(self, first: str = _ASCII_LETTERS + "_") -> str:
        """The next word, if it begins as a name does."""
        if self.next and self.next[0] in first:
            self.at += 1
            return self.words[self.at - 1]
        return ""

    def path(self, sign: str, first: str = _ASCII_LETTERS + "_") -> str:
        """Names joined by a sign without white space."""
        out = self.name(first)
        while out and self.next == sign and not self.spaced() and self.at + 1 < len(self.words) and self.words[self.at + 1][0] in first and self.starts[self.at + 1] == self.ends[self.at]:
            out += sign + self.words[self.at + 1]
            self.at += 2
        return out

    def nested(self, opening: str, closing: str) -> bool:
        """Passes over what a pair of signs encloses, if the opening one is next; False if it isn't closed."""
        if self.next != opening:
            return True
        depth = 0
        while self:
            x = self.next
            self.at += 1
            depth += (x == opening) - (x == closing)
            if not depth:
                return True
        return False

    def rest(self) -> str:
        return self.line[self.starts[self.at] :] if self else ""


LOWER, UPPER = _ASCII_LETTERS[:26], _ASCII_LETTERS[26:]


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def code_of(text: str, quotes: dict[str, str], line_comments: tuple[str, ...] = ("//",), block: tuple[str, str] | None = ("/*", "*/"), nests: bool = False, multiline: Collection[str] = (), raw: re.Pattern | None = None, keep: str = "") -> str:
    """text with white space in place of comments and of what quotes enclose. quotes: opening sign to closing sign,
    longer ones first; a backslash escapes within them, except in those that `multiline` has with a leading =. Quotes that
    aren't multiline end with their line. raw: a pattern with a group that tells what follows it up to its end."""
    signs = [*quotes, *line_comments, *(block or ())[:1]]
    start = re.compile("|".join([*([f"(?P<raw>{raw.pattern})"] if raw else []), *(f"(?:{re.escape(x)})" for x in sorted(signs, key=len, reverse=True))]))
    both = re.compile("|".join(map(re.escape, block))) if block else None
    out, at, n = [], 0, len(text)
    while at < n:
        m = start.search(text, at)
        if m is None:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        sign, begin = m[0], m.start()
        if raw and m["raw"] is not None:
            closing = raw.match(sign)
            end = text.find(closing_of(closing), m.end())
            end = n if end < 0 else end + len(closing_of(closing))
        elif sign in line_comments and sign not in quotes:
            if keep and text.startswith(keep, begin):
                out.append(sign)
                at = m.end()
                continue
            end = text.find("\n", begin)
            end = n if end < 0 else end
        elif block and sign == block[0]:
            depth, end = 1, m.end()
            while depth:
                x = both.search(text, end)
                if x is None:
                    end = n
                    break
                depth += 1 if x[0] == block[0] and nests else -1 if x[0] == block[1] else 0
                end = x.end()
        else:
            end = _quote_end(text, m.end(), quotes[sign], sign in multiline or f"={sign}" in multiline, f"={sign}" not in multiline)
        out.append(_blank(text[begin:end]))
        at = end
    return "".join(out)


def closing_of(m: re.Match) -> str:
    """The end that a raw text's beginning asks for."""
    return f'){m.group("mark")}"'


def _quote_end(text: str, at: int, closing: str, multiline: bool, escapes: bool) -> int:
    pattern = re.compile((r"\\.|" if escapes else "") + re.escape(closing) + ("" if multiline else r"|\n"), re.S)
    while True:
        m = pattern.search(text, at)
        if m is None:
            return len(text)
        if m[0] == closing:
            return m.end()
        if m[0] == "\n":
            return m.start()
        at = m.end()


def lines_of(code: str) -> Iterator[tuple[int, str]]:
    """Numbered lines, without an empty last one."""
    lines = code.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    yield from enumerate((x.removesuffix("\r") for x in lines), 1)

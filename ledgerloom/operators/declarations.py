"""Outlines of Go, by its declarations, and of Julia, by its blocks of keywords.

Both read a source once as a row of tokens: Go's top-level declarations are found by their keywords and matched
brackets, Julia's names by the depth of its blocks.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .heads import Head, code_of, lines_of

Entry = tuple[int, int, str, str]


# --- Go ---------------------------------------------------------------------------------------------------------------


class Token(NamedTuple):
    text: str
    line: int
    end_line: int


_GO_TOKEN = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[^\W\d]\w*)|(?P<dots>\.\.\.)|(?P<number>\d[\w.]*)|(?P<break>\n)|(?P<sign>[^\s\w])", re.S)
_ENDS_STATEMENT = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
_CLOSING = {"(": ")", "[": "]", "{": "}"}


class Source:
    """Tokens of a file, line breaks that end statements as ';', and its comments by line."""

    def __init__(self, text: str):
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int, str, bool]] = []  # first and last line, text, whether code stands before it
        line, code_line = 1, 0
        for m in _GO_TOKEN.finditer(text):
            kind, x = m.lastgroup, m[0]
            last = line + x.count("\n")
            if kind == "comment":
                self.comments.append((line, last, x, code_line == line))
                if last > line:
                    self._break(line)
            elif kind == "break":
                self._break(line)
                last = line + 1
            else:
                self.tokens.append(Token(x, line, last))
                code_line = last
            line = last
        self._break(line)

    def _break(self, line: int) -> None:
        """A line's end ends a statement after a name, a value or a closing sign."""
        if self.tokens and self.tokens[-1].text != ";":
            x = self.tokens[-1].text
            if x[0].isalnum() or x[0] in "_\"'`" or x in _ENDS_STATEMENT:
                self.tokens.append(Token(";", line, line))

    def doc_before(self, line: int) -> str:
        """The comments right above a line, without gaps."""
        parts: list[str] = []
        for first, last, text, beside in reversed(self.comments):
            if last == line - 1 and not beside:
                parts.append(text)
                line = first
            elif last < line - 1:
                break
        return _doc(parts[::-1])

    def doc_beside(self, line: int) -> str:
        return _doc([text for first, _, text, beside in self.comments if first == line and beside])


def _doc(comments: list[str]) -> str:
    """Text of comments, without signs and directives."""
    lines: list[str] = []
    for c in comments:
        if c.startswith("/*"):
            lines += c[2:].removesuffix("*/").split("\n")
        elif not re.match(r"//(?:line |extern |export |[a-z0-9]+:[a-z0-9])", c):
            lines.append(c[2:].removeprefix(" "))
    return "\n".join(x.rstrip() for x in lines).strip()


def first_sentence(doc: str) -> str:
    """Up to the first full stop, question or exclamation mark before white space; else 77 bytes of a long text."""
    doc = doc.strip()
    if m := re.search(r"[.!?](?=\s|\Z)", doc):
        return doc[: m.end()].strip()
    raw = doc.encode()
    return raw[:77].decode("utf-8", "ignore") + "..." if len(raw) > 80 else doc


class Reader:
    """Reads tokens from a place on."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def next(self) -> str:
        return self.tokens[self.at].text if self.at < len(self.tokens) else ""

    def pop(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def inside(self) -> list[Token]:
        """Tokens up to the sign that closes the next one; that sign is passed too."""
        begin, depth = self.at + 1, 0
        while self.at < len(self.tokens):
            x = self.pop().text
            depth += (x in _CLOSING) - (x in ")]}")
            if not depth:
                return self.tokens[begin : self.at - 1]
        return self.tokens[begin:]

    def statement(self) -> list[Token]:
        """Tokens up to the next ';' outside brackets; that is passed too."""
        begin, depth = self.at, 0
        while self.at < len(self.tokens):
            x = self.pop().text
            depth += (x in _CLOSING) - (x in ")]}")
            if x == ";" and depth <= 0:
                return self.tokens[begin : self.at - 1]
        return self.tokens[begin:]


def _parts(tokens: list[Token], sign: str) -> list[list[Token]]:
    """Pieces between a sign outside brackets; empty ones don't count."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        depth += (t.text in _CLOSING) - (t.text in ")]}")
        if t.text == sign and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _is_name(t: Token) -> bool:
    return t.text[0].isalpha() or t.text[0] == "_"


def go_type(tokens: list[Token]) -> str:
    """A type in short."""
    if not tokens:
        return "..."
    head, rest = tokens[0].text, tokens[1:]
    if head in ("*", "..."):
        return head + go_type(rest)
    if head == "[":
        r = Reader(tokens)
        size = r.inside()
        return ("[...]" if size else "[]") + go_type(tokens[r.at :])
    if head == "map":
        r = Reader(rest)
        key = r.inside()
        return f"map[{go_type(key)}]{go_type(rest[r.at :])}"
    if head == "interface":
        return "interface{}"
    if head == "func":
        return "func(...)"
    if head == "chan":
        return "chan " + go_type(rest[2:] if rest and rest[0].text == "<" else rest)
    if head == "<":  # a channel to read from
        return go_type(tokens[2:])
    if not _is_name(tokens[0]) or head == "struct":
        return "..."
    out, at = head, 1
    while at + 1 < len(tokens) and tokens[at].text == ".":
        out += "." + tokens[at + 1].text
        at += 2
    if at < len(tokens) and tokens[at].text == "[":
        r = Reader(tokens[at:])
        arguments = _parts(r.inside(), ",")
        return f"{out}[{go_type(arguments[0])}]" if len(arguments) == 1 else "..."
    return out


def go_parameters(tokens: list[Token]) -> list[tuple[list[str], list[Token]]]:
    """Names and type of each group of a parameter list; names are none where types stand alone."""
    parts = _parts([t for t in tokens if t.text != ";"], ",")
    # a part with a name and a type says that all have names
    named = any(len(p) > 1 and _is_name(p[0]) and p[0].text not in ("func", "map", "chan", "struct", "interface") and p[1].text not in (".", "[") or len(p) > 2 and _is_name(p[0]) and p[1].text == "[" and _names_an_array(p) for p in parts)
    if not named:
        return [([], p) for p in parts]
    out: list[tuple[list[str], list[Token]]] = []
    names: list[str] = []
    for p in parts:
        names.append(p[0].text)
        if len(p) > 1:
            out.append((names, p[1:]))
            names = []
    return out


def _names_an_array(p: list[Token]) -> bool:
    """`x []T` and `x [3]T`, not the type `x[T]`."""
    r = Reader(p[1:])
    r.inside()
    return r.at < len(p) - 1


def _flat(groups: list[tuple[list[str], list[Token]]]) -> list[str]:
    return [f"{n} {go_type(t)}" if n else go_type(t) for names, t in groups for n in (names or [""])]


def _exported(name: str) -> bool:
    return name[:1].isupper()


class Go:
    """Entries of one file."""

    def __init__(self, source: Source):
        self.source, self.r = source, Reader(source.tokens)
        self.entries: list[tuple[int, int, str]] = []
        self.symbols: list[str] = []

    def declarations(self) -> None:
        r = self.r
        while r.at < len(r.tokens):
            word, start = r.next, r.tokens[r.at].line
            if word == "func":
                self.function(start)
            elif word in ("import", "type", "const", "var"):
                r.pop()
                if r.next == "(":
                    begin = r.at
                    specs = _parts(r.inside(), ";")
                    end = r.tokens[r.at - 1].end_line if r.at > begin else start
                    r.statement()
                else:
                    spec = r.statement()
                    specs, end = [spec] if spec else [], spec[-1].end_line if spec else start
                self.general(word, start, end, specs)
            else:
                r.statement()

    def general(self, word: str, start: int, end: int, specs: list[list[Token]]) -> None:
        doc = first_sentence(self.source.doc_before(start))
        if word == "import":
            self.entries.append((start, end, f"imports ({len(specs)} packages)"))
        elif word == "type" and len(specs) == 1:
            name, kind = specs[0][0].text, self.kind(specs[0][1:])
            own = self.source.doc_beside(specs[0][-1].end_line) or (self.source.doc_before(specs[0][0].line) if specs[0][0].line != start else "")
            doc = first_sentence(own) or doc
            self.entries.append((start, end, f"type {name} {kind}" + (f" — {doc}" if doc else "")))
            self.symbols += [name] if _exported(name) else []
        elif word == "type":
            names = [s[0].text for s in specs]
            shown = [n for n in names if _exported(n)]
            self.symbols += shown
            self.entries.append((start, end, f"type {', '.join(shown or names)}"))
        else:
            shown = [n for n in self.value_names(specs) if _exported(n)]
            if shown:
                self.symbols += shown
                more = f" (+{len(shown) - 3} more)" if len(shown) > 3 else ""
                self.entries.append((start, end, f"{word} {', '.join(shown[:3])}{more}" + (f" — {doc}" if doc else "")))

    @staticmethod
    def value_names(specs: list[list[Token]]) -> list[str]:
        """Names on the left of each line of a const or var declaration."""
        out = []
        for s in specs:
            out.append(s[0].text)
            at = 1
            while at + 1 < len(s) and s[at].text == ",":
                out.append(s[at + 1].text)
                at += 2
        return out

    def kind(self, tokens: list[Token]) -> str:
        if tokens and tokens[0].text == "[" and len(tokens) > 1 and _is_name(tokens[1]) and not (len(tokens) > 2 and tokens[2].text == "]"):
            r = Reader(tokens)  # type parameters
            r.inside()
            tokens = tokens[r.at :]
        if tokens and tokens[0].text == "=":
            tokens = tokens[1:]
        head = tokens[0].text if tokens else ""
        if head in ("struct", "interface"):
            fields = _parts(Reader(tokens[1:]).inside(), ";")
            if head == "interface":
                return f"interface ({len(fields)} method{'' if len(fields) == 1 else 's'})"
            n = 0
            for f in fields:
                names = 1
                while 2 * names < len(f) and f[2 * names - 1].text == ",":
                    names += 1
                n += names
            return f"struct ({n} field{'' if n == 1 else 's'})"
        if head == "map":
            return "map type"
        if head == "[":
            return "slice type" if len(tokens) > 1 and tokens[1].text == "]" else "array type"
        if head == "func":
            return "func type"
        return f"= {head}" if len(tokens) == 1 and _is_name(tokens[0]) else "type"

    def function(self, start: int) -> None:
        r = self.r
        doc = first_sentence(self.source.doc_before(start))
        r.pop()
        receiver = ""
        if r.next == "(":
            own = r.inside()
            tokens = own[1:] if len(own) > 1 and _is_name(own[0]) and own[1].text not in (".", "[") else own
            star, tokens = ("*", tokens[1:]) if tokens and tokens[0].text == "*" else ("", tokens)
            if len(tokens) == 1:
                receiver = f"({star}{tokens[0].text}) "
            elif tokens and not star and len(tokens) > 1 and tokens[1].text == "[" and len(_parts(Reader(tokens[1:]).inside(), ",")) == 1:
                receiver = f"({tokens[0].text}[T]) "
            else:
                receiver = "(T) "
        name = r.pop().text if r.next and _is_name(r.tokens[r.at]) else ""
        if r.next == "[":
            r.inside()
        groups = go_parameters(r.inside()) if r.next == "(" else []
        given = ""
        if r.next == "(":
            results = go_parameters(r.inside())
            one = len(results) == 1 and not results[0][0]
            given = go_type(results[0][1]) if one else f"({', '.join(go_type(t) for _, t in results)})" if results else ""
        else:
            begin = r.at
            while r.next not in ("", ";", "{") or r.next == "{" and r.tokens[r.at - 1].text in ("interface", "struct"):
                if r.next in _CLOSING:
                    r.inside()
                else:
                    r.pop()
            given = go_type(r.tokens[begin : r.at]) if r.at > begin else ""
        end = r.tokens[r.at - 1].end_line
        if r.next == "{":
            r.inside()
            end = r.tokens[r.at - 1].end_line
        r.statement()
        shown = _flat(groups)
        signature = f"func {receiver}{name}({', '.join([*shown[:3], '...'] if len(shown) > 3 else shown)})" + (f" {given}" if given else "")
        self.entries.append((start, end, signature + (f" — {doc}" if doc else "")))
        if _exported(name):
            self.symbols.append(signature)


def scan_go(text: str, path: str) -> tuple[list[Entry], str, list[str], str] | None:
    source = Source(text)
    r = Reader(source.tokens)
    if r.next != "package" or len(r.tokens) < 2 or not _is_name(r.tokens[1]):
        return None
    at, package = r.tokens[0].line, r.tokens[1].text
    doc = first_sentence(source.doc_before(at))
    summary = doc if doc.lower().startswith("package ") else f"Package {package}" + (f" — {doc}" if doc else "")
    go = Go(source)
    go.r.statement()
    go.declarations()
    made = any("Code generated" in c or "DO NOT EDIT" in c for _, _, c, _ in source.comments)
    symbols = list(dict.fromkeys(go.symbols))
    entries = [(s, e, kind, "") for s, e, kind in go.entries] or [(1, max(1, text.count("\n")), f"package {package} (no exported declarations)", "")]
    return entries, summary, symbols, "generated file — edit the generator, not this file" if made else ""


# --- Julia ------------------------------------------------------------------------------------------------------------

# Words that open a block, and words that are no names.
_JL_OPENERS = frozenset("function module baremodule struct macro if for while let begin do try quote".split())
_JL_WORDS = frozenset("abstract baremodule begin break catch const continue do else elseif end export false finally for function global if import importall in let local macro module mutable new nothing primitive quote return struct true try type using where while".split())


def _julia_name(line: str) -> tuple[str, str]:
    """(group, name) of what a line declares."""
    h = Head(line, "!?")
    if h.take({"module", "baremodule"}):
        return "type", h.name()
    if h.take({"abstract", "primitive"}):
        return "type", h.name() if h.take({"type"}) else ""
    if h.take({"mutable"}) and h.next != "struct":
        return "", ""
    if h.take({"struct"}):
        return "type", h.name().rstrip("!?")
    if h.take({"function"}):
        name = h.path(".")
        return "fn", "" if name in _JL_WORDS else name
    if h.take({"macro"}):
        return "fn", h.name()
    if h.take({"const"}):
        name = h.name().rstrip("!?")
        return "fn", "" if name in _JL_WORDS else name
    return "", ""


def _julia_net(line: str) -> int:
    net = brackets = 0
    before, before_end = "", -1
    for m in re.finditer(r"[A-Za-z0-9_!?]+|[\[\]]", line):
        word = m[0]
        if word in "[]":
            brackets = max(0, brackets + (1 if word == "[" else -1))
        elif not brackets:
            typed = word == "type" and before in ("abstract", "primitive") and m.start() == before_end + 1
            net += (word in _JL_OPENERS or typed) - (word == "end")
        before, before_end = word, m.end()
    return net


def scan_julia(text: str, path: str) -> tuple[list[Entry], str, list[str], str] | None:
    quotes = {'"""': '"""', '"': '"', "`": "`"}
    code = re.sub(r"'(?:\\.[^'\n]{0,8}|[^'\\\n])'", lambda m: " " * len(m[0]), text) if "'" in text else text
    code = code_of(code, quotes, ("#",), ("#=", "=#"), True, ('="""', "`"))
    types: dict[str, None] = {}
    defs: dict[str, None] = {}
    depth = last = 0
    for no, line in lines_of(code):
        last = no
        if not depth:
            group, name = _julia_name(line.strip())
            if name:
                (types if group == "type" else defs)[name] = None
        depth = max(0, depth + _julia_net(line))
    if not types and not defs:
        return None
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    names = [*types, *defs]
    label = f"module {stem} — {', '.join(names[:4])}" + (f" (+{len(names) - 4})" if len(names) > 4 else "")
    parts = [f"{len(x)} {w}{'' if len(x) == 1 else 's'}" for x, w in ((types, "type"), (defs, "function")) if x]
    return [(1, last, label, "")], ", ".join([f"Julia — {stem}", *parts]), [*(f"type {x}" for x in types), *(f"fn {x}" for x in defs)], ""

"""Outlines of languages whose types are blocks in braces: Kotlin, Swift, C#, C and C++, Scala, PHP and Dart.

A source is first freed of its comments and texts, all at once; then braces can be counted and heads read word by word.
One walk over the lines serves all languages; a language says what heads a type, what is a member of one, and what
becomes of a head whose braces never open.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import takewhile
from typing import NamedTuple

from .heads import LOWER, Head, code_of, lines_of

Entry = tuple[int, int, str, str]
_NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"


class Block:
    def __init__(self, kind: str, name: str, start: int, whole: bool = False):
        self.kind, self.name, self.start, self.end, self.whole = kind, name, start, 0, whole
        self.members: list[str] = []
        self.group = ""  # an inner block whose members count too

    @property
    def title(self) -> str:
        return f"{self.kind} {self.name}"


class Language(NamedTuple):
    """title and kinds: of the summary, in its order; member: its word for members. code: frees a text of comments and
    texts. opens: the block that a line heads. adds: a member's name, '' for none. ended: what a head without braces
    becomes at another head (true: a block of its own) and at the file's end. skips: lines that head nothing."""

    title: str
    kinds: tuple[str, ...]
    member: str
    code: Callable[[str], str]
    opens: Callable[[str, int], Block | None]
    adds: Callable[[str, Block], str]
    at_head: bool = False
    at_end: bool = False
    closes: Callable[[str, Block], None] | None = None
    plural: Callable[[str], str] = lambda word: word + "s"
    inner: Callable[[str], str] | None = None


def scan_blocks(text: str, lang: Language) -> tuple[list[Entry], str] | None:
    code = list(lines_of(lang.code(text)))
    found: list[Block] = []
    cur: Block | None = None
    waiting: Block | None = None
    depth = 0

    def end(block: Block, no: int) -> None:
        block.end = no
        found.append(block)

    for no, line in code:
        t = line.strip()
        if not t:
            continue
        net = t.count("{") - t.count("}")
        if waiting is not None:
            head = lang.opens(t, no) if lang.at_head and (net <= 0 or lang.inner is not None) else None
            if head is None:
                if net > 0:
                    cur, depth, waiting = waiting, net, None
                elif net < 0 and lang.inner is None:
                    waiting = None
                continue
            end(waiting, no - 1)
            waiting = None
        if cur is not None:
            if depth == 1:
                if lang.inner is not None and (group := lang.inner(t)):
                    cur.group = group
                elif name := lang.adds(t, cur):
                    cur.members.append(name)
            elif depth == 2 and cur.group and (name := lang.adds(t, cur)):
                cur.members.append(f"{cur.group}.{name}")
            depth += net
            if depth <= 0:
                if lang.closes is not None:
                    lang.closes(t, cur)
                end(cur, no)
                cur = None
            elif depth == 1:
                cur.group = ""
            continue
        head = lang.opens(t, no)
        if head is None:
            continue
        if net > 0:
            cur, depth = head, net
        elif head.whole:
            end(head, no)
        elif ";" not in t or lang.at_end:
            waiting = head
    last = len(code)
    if waiting is not None and lang.at_end:
        end(waiting, last)
    if cur is not None:
        end(cur, last)
    if not found:
        return None
    kinds, members = Counter(b.kind for b in found), sum(len(b.members) for b in found)
    parts = []
    for kind in lang.kinds:
        if n := kinds[kind]:
            *first, word = kind.split(" ")
            parts.append(f"{n} {' '.join([*first, word if n == 1 else lang.plural(word)])}")
    if members:
        parts.append(f"{members} {lang.member}{'' if members == 1 else 's'}")
    out = []
    for b in found:
        shown = ", ".join(b.members[:4]) + (f" (+{len(b.members) - 4})" if len(b.members) > 4 else "")
        out.append((b.start, b.end, b.title + (f" — {shown}" if shown else ""), b.title))
    return out, f"{lang.title} — " + ", ".join(parts)


def _annotations(h: Head, sign: str = "@") -> None:
    """Passes over @Name and @Name(...)."""
    while h.next == sign:
        h.at += 1
        h.name()
        while h.next == "." and not h.spaced():
            h.at += 1
            h.name()
        if h.next == "(" and not h.spaced():
            h.nested("(", ")")


def _attributes(h: Head) -> None:
    """Passes over [...]."""
    while h.next == "[" and h.nested("[", "]"):
        pass


def typed(line: str, start: int, shapes: set[str], keywords: set[str], visible: set[str], more: str = "") -> Block | None:
    """visible words, then words that shape the kind, a keyword, a name."""
    h = Head(line, more)
    _annotations(h)
    h.skip(visible)
    shape = h.skip(shapes - keywords)
    word = h.take(keywords)
    name = h.name(_NAME + more) if word else ""
    return Block(" ".join([*shape, word]), name, start) if name else None


# Fixed values, in this file: modifiers, kinds in the order of summaries, and words that are no member's name.

# --- Kotlin -----------------------------------------------------------------------------------------------------------

_KT_VISIBLE = {"public", "private", "protected", "internal", "actual", "expect"}
_KT_SHAPES = {"abstract", "open", "sealed", "data", "inner", "inline", "value", "annotation"}
_KT_FUN = _KT_VISIBLE | {"abstract", "open", "override", "suspend", "inline", "tailrec", "external", "operator", "infix", "noinline", "crossinline"}


def _kotlin_fun(line: str) -> str:
    h = Head(line)
    h.skip(_KT_FUN)
    if not h.take({"fun"}) or not h.nested("<", ">"):
        return ""
    name = h.name()
    while name and h.next == ".":
        h.at += 1
        name += f".{h.name()}"
    return name.rstrip(".")


def _is_companion(line: str) -> bool:
    h = Head(line)
    return bool(h.take({"companion"}) and h.take({"object"}))


class _Kotlin:
    """Heads of one file; companions are numbered."""

    def __init__(self) -> None:
        self.companions: dict[int, int] = {}

    def opens(self, line: str, no: int) -> Block | None:
        if _is_companion(line):
            number = self.companions.setdefault(no, len(self.companions) + 1)
            return Block("companion object", f"companion object #{number}", no)
        h = Head(line)
        h.skip(_KT_VISIBLE)
        shape = [*h.skip(_KT_SHAPES), h.take({"enum"})]
        word = h.take({"class", "interface", "object"})
        if name := word and h.name():
            return Block(" ".join(x for x in [*shape, word] if x), name, no)
        name = _kotlin_fun(line)
        return Block("fun", name, no, True) if name else None


def scan_kotlin(text: str, path: str) -> tuple[list[Entry], str] | None:
    kinds = ("class", "data class", "sealed class", "enum class", "interface", "object", "companion object", "fun")
    lang = Language("Kotlin", kinds, "method", lambda x: code_of(x, {'"""': '"""', '"': '"', "'": "'"}, multiline=('="""',)), _Kotlin().opens, lambda t, _: _kotlin_fun(t), at_head=True, at_end=True, inner=lambda t: "companion" if _is_companion(t) else "")
    return scan_blocks(text, lang)


# --- Swift ------------------------------------------------------------------------------------------------------------

_SWIFT_VISIBLE = {"public", "private", "internal", "fileprivate", "open"}
_SWIFT_KINDS = {"class", "struct", "enum", "protocol", "actor", "extension"}
_SWIFT_FUNC = _SWIFT_VISIBLE | {"override", "static", "class", "mutating", "nonmutating", "dynamic", "final", "required", "convenience", "nonisolated"}


def _swift_opens(line: str, no: int) -> Block | None:
    h = Head(line)
    _annotations(h)
    words = h.skip(_SWIFT_VISIBLE | {"final"})
    word = h.take(_SWIFT_KINDS)
    name = h.name() if word else ""
    # `open` shapes the kind only after `final`; alone it is a matter of who sees the type
    shape = words[words.index("final") :] if "final" in words else []
    return Block(" ".join([*(x for x in shape if x in ("final", "open")), word]), name, no) if name else None


def _swift_member(line: str, _: Block) -> str:
    h = Head(line)
    h.skip(_SWIFT_VISIBLE | {"override", "required", "convenience"})
    if h.take({"init", "deinit"}):
        return "init" if h.next in tuple("({?!") else ""
    h = Head(line)
    _annotations(h)
    h.skip(_SWIFT_FUNC)
    return h.name() if h.take({"func"}) else ""


SWIFT = Language(
    "Swift", ("class", "final class", "open class", "struct", "enum", "protocol", "actor", "extension"), "func",
    lambda x: code_of(x, {'"""': '"""', '"': '"'}, nests=True, multiline=('"""',)), _swift_opens, _swift_member,
)


def scan_swift(text: str, path: str) -> tuple[list[Entry], str] | None:
    return scan_blocks(text, SWIFT)


# --- C# ---------------------------------------------------------------------------------------------------------------

_CS_VISIBLE = {"public", "private", "protected", "internal", "file"}
_CS_SHAPES = {"abstract", "sealed", "static", "partial", "unsafe", "readonly"}
_CS_WORDS = frozenset(
    "if for foreach while switch return new throw catch try else do case break continue using class interface struct enum record namespace delegate event operator implicit explicit typeof sizeof checked unchecked lock fixed unsafe var void get set init add remove yield await async where select from in is as base this default null true false".split()
)


def _cs_opens(line: str, no: int) -> Block | None:
    h = Head(line)
    _attributes(h)
    h.skip(_CS_VISIBLE)
    shape = h.skip(_CS_SHAPES)
    word = h.take({"class", "struct", "interface", "enum", "record"})
    if word == "record":
        word = " ".join(x for x in (word, h.take({"class", "struct"})) if x)
    name = h.name() if word else ""
    return Block(" ".join([*shape, word]), name, no) if name else None


_TYPE_SIGNS = frozenset("_.<>[]?,@ \t")
_CS_PLACE = re.compile(r"\s([A-Za-z_]\w*)\s*(?=<|$)", re.A)


def _is_property(line: str) -> bool:
    """An accessor right behind a brace."""
    h = Head(line)
    return any(x == "{" and y in ("get", "set", "init") for x, y in zip(h.words, h.words[1:], strict=False))


def _cs_member(line: str, _: Block) -> str:
    """The last name that stands behind a type and before a parenthesis or type parameters."""
    if line.startswith("[") or _is_property(line):
        return ""
    head = "".join(takewhile(lambda c: c.isalnum() or c in _TYPE_SIGNS, line))
    called = line[len(head) : len(head) + 1] == "("
    head = head.rstrip()
    names = [m[1] for m in _CS_PLACE.finditer(head) if called or m.end() < len(head)]
    name = names[-1] if names and (head[0] in _NAME or head[0] == "@") else ""
    return "" if name in _CS_WORDS else name


_CS_QUOTES = {'"""': '"""', '$@"': '"', '@"': '"', '"': '"', "'": "'"}
CSHARP = Language(
    "C#", ("class", "abstract class", "sealed class", "static class", "partial class", "record", "record class", "record struct", "struct", "interface", "enum"), "method",
    lambda x: code_of(x, _CS_QUOTES, multiline=('="""', '=@"', '=$@"')), _cs_opens, _cs_member, at_end=True,
)


def scan_csharp(text: str, path: str) -> tuple[list[Entry], str] | None:
    return scan_blocks(text, CSHARP)


# --- C and C++ --------------------------------------------------------------------------------------------------------

_CPP_BEFORE = {"inline", "static", "extern", "explicit", "virtual", "friend", "constexpr", "consteval", "constinit"}
_CPP_WORDS = frozenset(
    "if else for while do switch case break continue return goto try catch throw new delete sizeof alignof decltype typeid typeof static_assert class struct union enum namespace template typename virtual override final inline static extern const constexpr consteval constinit volatile mutable auto register friend explicit operator this nullptr true false using typedef public private protected".split()
)


def _behind_brace(line: str) -> str:
    """The name between the last closing brace and the semicolon."""
    h = Head(line[line.rfind("}") + 1 :])
    name = h.name()
    return name if h.next == ";" else ""


def _cpp_opens(line: str, no: int) -> Block | None:
    if line.startswith("#"):
        return None
    h = Head(line)
    if h.take({"typedef"}):
        word = h.take({"struct", "union", "enum"})
        if not word or h.next != "{":
            return None
        name = _behind_brace(line) if line.count("{") == line.count("}") else ""
        return Block(word, name, no, bool(name))
    if h.take({"template"}) and not h.nested("<", ">"):
        return None
    h.skip(_CPP_BEFORE)
    word = h.take({"class", "struct", "union", "enum"})
    if word == "enum" and h.take({"class"}):
        word = "enum class"
    while word and h.take({"__attribute__"}):
        h.nested("(", ")")
    name = h.name() if word else ""
    while name and h.next == ":" and line[h.ends[h.at] : h.ends[h.at] + 1] == ":":
        h.at += 2
        name = h.name() or name
    return Block(word, name, no) if name else None


def _cpp_member(line: str, block: Block) -> str:
    """The name before the first parenthesis, if nothing but types stands before it."""
    if line.startswith("#") or "(" not in line:
        return ""
    m = re.search(r"(~?[A-Za-z_]\w*)\s*\Z", line.split("(", 1)[0], re.A)
    if m is None or re.search(r"[^\w:<>*&, \t~]", line[: m.start()], re.A) or "~" in line[: m.start()]:
        return ""
    return "" if m[1] in _CPP_WORDS or m[1] == block.name else m[1]


def _cpp_closes(line: str, block: Block) -> None:
    if not block.name and line.startswith("}"):
        block.name = _behind_brace(line)


_CPP_RAW = re.compile(r'R"(?P<mark>[^(")\s\\]*)\(')
CPP = Language(
    "C/C++", ("class", "struct", "union", "enum", "enum class"), "method",
    lambda x: code_of(x, {'"': '"', "'": "'"}, raw=_CPP_RAW), _cpp_opens, _cpp_member, closes=_cpp_closes,
)


def scan_cpp(text: str, path: str) -> tuple[list[Entry], str] | None:
    return scan_blocks(text, CPP)


# --- Scala ------------------------------------------------------------------------------------------------------------

_SCALA_VISIBLE = {"private", "protected", "public", "override", "implicit", "lazy"}
_SCALA_SHAPES = {"case", "sealed", "abstract", "final", "open"}
_SCALA_DEF = {"private", "protected", "override", "implicit", "inline", "transparent", "final", "abstract", "lazy"}
_SCALA_WORDS = frozenset(
    "if else for while do match case return try catch throw new class object trait enum val var def type import package extends with override abstract sealed final implicit lazy this super null true false yield given using inline transparent opaque".split()
)


def _scala_opens(line: str, no: int) -> Block | None:
    return typed(line, no, _SCALA_SHAPES, {"class", "object", "trait", "enum"}, _SCALA_VISIBLE)


def _scala_member(line: str, _: Block) -> str:
    h = Head(line, "?!")
    _annotations(h)
    h.skip(_SCALA_DEF)
    name = h.name() if h.take({"def"}) else ""
    return "" if name in _SCALA_WORDS else name


SCALA = Language(
    "Scala", ("class", "abstract class", "sealed class", "final class", "case class", "open class", "object", "case object", "trait", "sealed trait", "open trait", "enum", "sealed enum"), "def",
    lambda x: code_of(x, {'"""': '"""', '"': '"'}, nests=True, multiline=('="""',)), _scala_opens, _scala_member, at_head=True, at_end=True,
)


def scan_scala(text: str, path: str) -> tuple[list[Entry], str] | None:
    return scan_blocks(text, SCALA)


# --- PHP --------------------------------------------------------------------------------------------------------------

_PHP_SHAPES = {"abstract", "final", "readonly"}
_PHP_BEFORE = {"public", "protected", "private", "static", "abstract", "final", "readonly"}
_PHP_WORDS = frozenset("if else elseif for foreach while do switch case break continue return echo print die exit try catch throw new class interface trait enum namespace use include require match list array".split())


def _php_attributes(h: Head) -> None:
    while h.next == "#" and h.line[h.ends[h.at] : h.ends[h.at] + 1] == "[":
        h.at += 1
        h.nested("[", "]")


def _php_opens(line: str, no: int) -> Block | None:
    h = Head(line)
    _php_attributes(h)
    shape = h.skip(_PHP_SHAPES)
    word = h.take({"class", "interface", "trait", "enum"})
    name = h.name() if word else ""
    return Block(" ".join([*shape, word]), name, no) if name else None


def _php_member(line: str, _: Block) -> str:
    if line.startswith("#["):
        return ""
    h = Head(line)
    h.skip(_PHP_BEFORE)
    name = h.name() if h.take({"function"}) else ""
    return "" if name in _PHP_WORDS else name


_HEREDOC = re.compile(r"<<<(['\"]?)([A-Za-z_]\w*)\1", re.A)


def _php_code(text: str) -> str:
    """Code without here-documents, whose ends stand on lines of their own; they begin where code is, not text."""
    out, rest = [], text
    while True:
        code = code_of(rest, {'"': '"', "'": "'"}, ("//", "#"), multiline=('"', "'"), keep="#[")
        # a label in quotes is blanked with them, so the place is sought by its sign
        at = code.find("<<<")
        m = _HEREDOC.match(rest, at) if at >= 0 else None
        while at >= 0 and m is None:
            at = code.find("<<<", at + 3)
            m = _HEREDOC.match(rest, at) if at >= 0 else None
        if m is None:
            return "".join([*out, code])
        line_start = rest.rfind("\n", 0, at) + 1
        closing = re.compile(rf"^[ \t]*{m[2]};?[ \t\r]*$", re.M).search(rest, m.end())
        stop = closing.end() if closing else len(rest)
        out.append(code[:line_start] + re.sub(r"[^\n]", " ", rest[line_start:stop]))
        rest = rest[stop:]


PHP = Language(
    "PHP", ("class", "abstract class", "final class", "readonly class", "interface", "trait", "enum"), "method", _php_code, _php_opens, _php_member,
    plural=lambda word: word + ("es" if word.endswith(("s", "x", "ch", "sh")) else "s"),
)


def scan_php(text: str, path: str) -> tuple[list[Entry], str] | None:
    return scan_blocks(text, PHP)


# --- Dart -------------------------------------------------------------------------------------------------------------

_DART_SHAPES = {"abstract", "final", "base", "interface", "sealed", "mixin"}
_DART_WORDS = frozenset(
    "if else for while do switch case break continue return new throw try catch finally assert await yield in is as var final const late static class mixin enum extension typedef import export library part show hide abstract sealed base interface override covariant external factory this super null true false implements extends with on required dynamic Function".split()
)


def _dart_opens(line: str, no: int) -> Block | None:
    h = Head(line, "$")
    _annotations(h)
    words = h.skip(_DART_SHAPES | {"class", "enum"})
    # the last of these words that can be a keyword is one; `mixin` shapes what stands before `class`
    while words and words[-1] not in ("class", "mixin", "enum"):
        words.pop()
        h.at -= 1
    if words and not any(w in ("class", "enum") for w in words[:-1]) and (name := h.name(_NAME + "$")):
        return Block(" ".join(words), name, no)
    h = Head(line, "$")
    if h.take({"extension"}):
        name = "" if h.next == "on" and h.at + 1 < len(h.words) and h.words[h.at + 1] != "on" else h.name(_NAME + "$")
        if h.take({"on"}) and (on := re.match(r"[^{;\n]+", h.rest())):
            return Block("extension", name or f"on {on[0].strip()}", no)
    return None


def _plain(head: str) -> list[str]:
    """Words of a head, type parameters taken out that nest once at most."""
    for _ in range(2):
        head = re.sub(r"<[^<>]*>", "", head)
    return head.split()


_WORD = re.compile(r"[A-Za-z_$][\w$]*[?!]?\Z", re.A)


def _dart_member(line: str, _: Block) -> str:
    h = Head(line, "$")
    _annotations(h)
    line = h.rest()
    called = _plain(line.split("(", 1)[0]) if "(" in line else []
    name = ""
    if len(called) > 1 and all(map(_WORD.match, called)):
        name = called[-1]
    else:
        words = _plain(re.split(r"=>|[{;(]", line, maxsplit=1)[0])
        if "get" in words[1:-1] and all(map(_WORD.match, words)):
            name = words[words.index("get", 1) + 1]
    return name if name and name[0] in LOWER + "_$" and name not in _DART_WORDS else ""


DART = Language(
    "Dart", ("class", "abstract class", "final class", "base class", "interface class", "sealed class", "abstract interface class", "abstract base class", "mixin", "mixin class", "enum", "extension"), "method",
    lambda x: code_of(x, {'"""': '"""', "'''": "'''", '"': '"', "'": "'"}, multiline=('"', "'", '"""', "'''")), _dart_opens, _dart_member, plural=lambda word: word + ("es" if word == "class" else "s"),
)


def scan_dart(text: str, path: str) -> tuple[list[Entry], str] | None:
    return scan_blocks(text, DART)

"""Function definitions of C sources, by their grammar: tokens, a stack of braces and conditionals, and the declarator of each head.

One pass over the source, in time linear in it. Comments, strings and directives aren't code. At the top level the tokens of a declaration are gathered until its
semicolon or brace; inside a body only braces and conditionals count. Where the branches of a conditional leave different braces open, the first branch counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# Fixed values.
KEYWORDS = {"if", "else", "for", "while", "do", "switch", "case", "default", "return", "break", "continue", "goto", "sizeof", "typedef", "struct", "union", "enum", "extern", "register", "auto"}
UNMATCHED = "Unmatched braces for function {}"
SMALL_LINES = 10

#: Words that a declaration may begin with and that aren't its type.
_STORAGE = {"static", "inline", "__inline", "__inline__", "const", "volatile", "restrict", "extern", "register", "auto", "_Noreturn", "__extension__"}
_TYPES = {"void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "_Complex", "bool"}
#: Words that a group in parentheses belongs to, neither of which is part of a declarator.
_ATTRIBUTES = {"__attribute__", "__attribute", "__declspec", "__asm__", "__asm", "asm", "_Alignas", "alignas", "_Static_assert", "static_assert", "__typeof__", "typeof"}

_NOT_CODE = r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<line>^[ \t]*\#(?:/\*.*?(?:\*/|\Z)|\\\r?\n|[^\n])*)"""
_TOKEN = re.compile(_NOT_CODE + r"|(?P<word>\w+)|(?P<mark>[{}()\[\];=*:])", re.DOTALL | re.MULTILINE)
_BODY_TOKEN = re.compile(_NOT_CODE + r"|(?P<mark>[{}])", re.DOTALL | re.MULTILINE)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(if|elif|else|endif)")


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    #: Of a group in parentheses: its tokens.
    inner: list = []


class Definition(NamedTuple):
    name: str
    start: int
    brace: int


def _grouped(tokens: list[Token]) -> list[Token]:
    """The tokens with each pair of parentheses as one; attributes and what stands in brackets are left out."""
    stack: list[list[Token]] = [[]]
    for t in tokens:
        if t.text in ("(", "["):
            stack[-1].append(Token("group" if t.text == "(" else "square", t.text, t.start, []))
            stack.append(stack[-1][-1].inner)
        elif t.text in (")", "]"):
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1].append(t)
    return _without_attributes(stack[0])


def _without_attributes(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    for t in tokens:
        if t.kind == "square":
            continue
        if t.kind == "group" and out and out[-1].text in _ATTRIBUTES:
            out.pop()
        elif t.kind == "group":
            out.append(t._replace(inner=_without_attributes(t.inner)))
        else:
            out.append(t)
    return out


def _declared(tokens: list[Token]) -> str | None:
    """The name that a declarator with a parameter list declares. A name followed by a group is one, and so is a group that holds one or stands before another group;
    with nothing but storage words before it, a name and its group are a macro if a further one follows."""
    found: list[tuple[str, bool]] = []
    typed = False
    for k, t in enumerate(tokens):
        after = tokens[k + 1] if k + 1 < len(tokens) else None
        if t.kind == "word" and t.text in _TYPES:
            typed = True
        elif t.kind == "word" and after is not None and after.kind == "group":
            wrapped = _wrapped(after.inner, k + 2 < len(tokens) and tokens[k + 2].kind == "group")
            if wrapped:
                return wrapped if wrapped not in KEYWORDS else None
            if t.text in KEYWORDS:
                return None
            found.append((t.text, typed))
            typed = True
        elif t.kind == "word" and t.text not in _STORAGE:
            typed = True
        elif t.kind == "group" and k and tokens[k - 1].text in (*_TYPES, "*", "}"):
            wrapped = _wrapped(t.inner, after is not None and after.kind == "group")
            if wrapped:
                return wrapped
    if not found:
        return None
    return found[0][0] if found[0][1] or len(found) == 1 else found[1][0]


def _wrapped(inner: list[Token], more: bool) -> str | None:
    """The name inside a group that is a declarator itself: `* name (...)`, or `name` or `* name` before another group."""
    bare = [t for t in inner if t.text != "*" and t.text not in ("const", "volatile", "restrict")]
    stars = bool(inner) and inner[0].text == "*"
    if len(bare) == 1 and bare[0].kind == "word" and more and (stars or len(inner) == 1) and bare[0].text not in _TYPES:
        return bare[0].text if not stars else None  # a pointer to a function is no definition
    if stars and bare:
        if bare[0].kind == "word" and len(bare) > 1 and bare[1].kind == "group":
            return bare[0].text
        if bare[0].kind == "group":
            return _wrapped(bare[0].inner, len(bare) > 1)
    return None


def _old_style(head: list[Token]) -> bool:
    """Whether a declaration that ends here may be one of a parameter, after a list of bare names."""
    groups = [k for k, t in enumerate(head) if t.kind == "group"]
    return bool(groups) and groups[0] > 0 and head[groups[0] - 1].kind == "word" and bool(head[groups[0]].inner) and all(t.kind == "word" for t in head[groups[0]].inner) and groups[0] + 1 < len(head)


def _defined(tokens: list[Token], brace: int) -> Definition | None:
    """The definition whose body begins at a brace, of the tokens of the declaration before it; None for types, initialisers and other blocks."""
    parts: list[list[Token]] = [[]]
    for t in tokens:
        if t.text == ";" and t.kind == "mark":
            parts.append([])
        else:
            parts[-1].append(t)
    own = parts[-1] if parts[-1] or len(parts) == 1 else parts[0]
    if not own or own[0].text == "typedef" or any(t.text == "=" for t in _top(own)):
        return None
    name = _declared(_grouped(own))
    return Definition(name, own[0].start, brace) if name and name not in KEYWORDS else None


def _top(tokens: list[Token]) -> Iterator[Token]:
    depth = 0
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0:
            yield t


def definitions(source: str) -> Iterator[tuple[Definition, int] | Definition]:
    """Each definition with the place after its body as that ends, in order; at the end the one whose body doesn't, alone."""
    depth, at, skipping = 0, 0, False
    head: list[Token] = []
    old = False  # the head holds a list of bare names and declarations of them
    begun: Definition | None = None
    #: Of each conditional that is open: the depth before it, the depth after its first branch.
    branches: list[list[int | None]] = []
    hidden = 0
    while True:
        m = (_BODY_TOKEN if depth else _TOKEN).search(source, at)
        if not m:
            break
        at = m.end()
        kind, text = m.lastgroup, m[0]
        if kind == "line":
            word = _DIRECTIVE.match(text)
            if not word:
                continue
            if word[1] == "if":
                hidden += skipping
                if not skipping:
                    branches.append([depth, None])
            elif hidden:
                hidden -= word[1] == "endif"
            elif branches:
                if branches[-1][1] is None:
                    branches[-1][1] = depth
                skipping = word[1] != "endif" and branches[-1][1] != branches[-1][0]
                if word[1] == "endif":
                    first = branches.pop()[1]
                    depth = max(depth, first) if depth and first else depth
        elif skipping or kind == "comment":
            continue
        elif text == "{":
            if depth == 0:
                block = [t.text for t in head if t.kind != "text"]
                if block[-1:] == ["extern"] and head[-1].kind == "text" or block[:1] == ["namespace"]:
                    head, old = [], False
                    continue
                begun = _defined(head, m.start())
            depth += 1
        elif text == "}":
            if depth == 1:
                if begun:
                    yield begun, m.end()
                # a type or an initialiser goes on behind its block; of what stands before it only that matters
                head = [] if begun or not head else [head[0]] + [t for t in head if t.text == "="][:1]
                begun, old = None, False
            depth = max(0, depth - 1)
        elif depth == 0:
            if text == ";" and not old:
                old = bool(head) and _old_style(_grouped(head))
                head = head if old else []
            if text != ";" or old:
                head.append(Token(kind, text, m.start()))
    if depth and begun:
        yield begun


class Lines:
    """Line numbers of places that are asked in order: each end of line is counted once, and again within a span, so no list of them is held."""

    def __init__(self, source: str) -> None:
        self.source, self.at, self.line = source, 0, 1

    def of(self, start: int, end: int) -> tuple[int, int]:
        """The lines of a span's first place and of the place after it. Starts may not fall."""
        self.line += self.source.count("\n", self.at, start)
        self.at = start
        return self.line, self.line + self.source.count("\n", start, end)


def found_definitions(source: str) -> Iterator[tuple | str]:
    """Function rows (seq, name, start_line, end_line, signature, body, (start, end), is_small) of one source in order, and errors. Offsets are in characters."""
    lines, seq = Lines(source), 0
    for found in definitions(source):
        if isinstance(found, Definition):
            yield UNMATCHED.format(found.name)
        else:
            yield seq, *function_row(source, lines, *found)
            seq += 1


def parse_definitions(source: str) -> tuple[list[tuple], list[str]]:
    """found_definitions as lists of rows and errors."""
    found = list(found_definitions(source))
    return [x for x in found if not isinstance(x, str)], [x for x in found if isinstance(x, str)]


def function_row(source: str, lines: Lines, head: Definition, end: int) -> tuple:
    first, last = lines.of(head.start, end)
    return head.name, first, last, source[head.start : head.brace].strip(), source[head.start : end], (head.start, end), last - first + 1 < SMALL_LINES
